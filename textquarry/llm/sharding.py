"""Minimax contiguous partition: shards of near equal bytes from ordered, atomic groups of equal texts.

Groups are ordered by the hash of their text. The smallest capacity with which a greedy walk fills the shards is found by binary
search, and the groups are cut where that walk ends its shards. A group above an equal share of what is left gets a shard of its own
before the rest is partitioned: it sets no capacity for others.

The driver never sees the groups. It holds cells, ranges of the hash with the bytes in them, and bounds the walk from both sides:
with cells that cannot be split (too early cuts, enough capacity), and with cells that can be split anywhere (too late cuts, too
little capacity). Only cells in which a cut may lie are counted at a finer grain, in one aggregation for all of them, until every
such cell is a single group. The number of cells follows from the shards, not from the documents: 2^14 at first, then 32 for each
that a cut may lie in.

Nulls: a null text has the size and checksum of an empty one and is of its group. Null and repeated document ids are rows like any
other; equal rows get different slots. Texts of one 64-bit hash are one group. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.common import stored

ROW_BYTES = 16
FIRST_BITS = 14
MORE_BITS = 5


@dataclass(frozen=True)
class Cell:
    """Groups whose hash (as an unsigned number) begins with ``prefix`` of ``bits`` bits."""

    bits: int
    prefix: int
    size: int
    groups: int

    @property
    def first(self) -> int:
        return self.prefix << (64 - self.bits)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits)


def _cells(groups: DataFrame, bits: int) -> list[Cell]:
    counted = groups.groupBy(_prefix(bits).alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    return [Cell(bits, r["p"], r["s"], r["n"]) for r in counted.collect()]


def _split(groups: DataFrame, cells: list[Cell]) -> list[Cell]:
    """Finer cells of some cells, counted in one pass for those of the same grain."""
    out = []
    for bits in sorted({c.bits for c in cells}):
        finer = min(64, bits + MORE_BITS)
        wanted = groups.sparkSession.createDataFrame([(c.prefix,) for c in cells if c.bits == bits], "p long")
        inside = groups.join(F.broadcast(wanted), _prefix(bits) == F.col("p"), "left_semi")  # some cells for each cut
        out += [c for c in _cells(inside, finer)] if finer < 64 else [Cell(64, r["key"] % (1 << 64), r["size"], 1) for r in inside.collect()]
    return out


class Walk:
    """Greedy walks over cells in the order of their hashes."""

    def __init__(self, cells: list[Cell], shards: int):
        self.cells = sorted(cells, key=lambda c: c.first)
        self.size = [c.size for c in self.cells]
        self.ends = np.concatenate(([0], np.cumsum(np.array(self.size, np.int64)))) if cells else np.zeros(1, np.int64)
        self.whole = [c.groups == 1 for c in self.cells]
        self.shards = shards

    def early(self, capacity: int) -> list[int] | None:
        """Byte places of the cuts if no cell can be split; none if the shards do not suffice."""
        at, cuts = 0, []
        for _ in range(self.shards):
            if at == len(self.cells):
                break
            nxt = int(np.searchsorted(self.ends, self.ends[at] + capacity, side="right")) - 1
            if nxt == at:
                return None
            at = nxt
            cuts.append(int(self.ends[at]))
        return cuts if at == len(self.cells) else None

    def late(self, capacity: int) -> list[int] | None:
        """The same if a cell of several groups can be split at any byte."""
        at, total, cuts = 0, int(self.ends[-1]), []
        for _ in range(self.shards):
            if at >= total:
                break
            place = min(at + capacity, total)
            i = int(np.searchsorted(self.ends, place, side="right")) - 1
            if place < total and self.whole[i]:
                place = int(self.ends[i])
            if place <= at:
                return None
            at = place
            cuts.append(at)
        return cuts if at >= total else None

    def earliest(self, capacity: int) -> list[int]:
        """Lower bounds of the cuts, also where a cell alone is above the capacity: then its own start."""
        at, cuts = 0, []
        for _ in range(self.shards):
            at = max(at, int(np.searchsorted(self.ends, self.ends[at] + capacity, side="right")) - 1)
            cuts.append(int(self.ends[at]))
        return cuts


def _smallest(fits, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def find_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the hash (unsigned) at which every shard but the first begins. ``groups``: ``key, size``, one row
    for each group."""
    walk = Walk(_cells(groups, FIRST_BITS), shards)
    while True:
        total = int(walk.ends[-1])
        if not total:
            return 0, []
        least = _smallest(lambda c: walk.late(c) is not None, -(-total // shards), total)
        enough = _smallest(lambda c: walk.early(c) is not None, least, total)
        low, high = walk.earliest(least), walk.late(enough)
        high += [total] * (len(low) - len(high))
        open_ = set()
        for a, b in zip(low, high):
            i, j = int(np.searchsorted(walk.ends, a, side="right")) - 1, int(np.searchsorted(walk.ends, b, side="left"))
            open_.update(k for k in range(i, min(j, len(walk.cells))) if not walk.whole[k])
        if least == enough and not open_:
            cuts = walk.early(enough)
            return enough, [walk.cells[int(np.searchsorted(walk.ends, c))].first for c in cuts[:-1]]
        finer = _split(groups, [walk.cells[k] for k in sorted(open_)])
        walk = Walk([c for k, c in enumerate(walk.cells) if k not in open_] + finer, shards)


def _alone(groups: DataFrame, shards: int) -> list[int]:
    """Keys of the groups that get a shard of their own: each above an equal share of what the larger ones leave."""
    left = groups.agg(F.sum("size")).first()[0] or 0
    keys: list[int] = []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards - 1).collect():
        if r["size"] * (shards - len(keys)) <= left:
            break
        keys.append(r["key"])
        left -= r["size"]
    return keys


def assign_shards(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", rows_per_block: int = 50_000) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. Texts do not move; thin rows do.

    Slots number the documents of a shard without gaps: rows are dealt to blocks of about ``rows_per_block`` by the hash of id and
    text, numbered within a block by id, and a block starts where those before it end.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + ROW_BYTES).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("key"))
    rows = stored(rows, "sizes")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    alone = _alone(groups, shards)
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    _, cuts = find_cuts(rest, shards - len(alone))
    flip = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order as signed
    shard = F.lit(len(alone))
    for cut in cuts:
        shard = shard + (flip >= F.lit(_signed(cut ^ (1 << 63)))).cast("int")
    for n, key in enumerate(alone):
        shard = F.when(F.col("key") == key, F.lit(n)).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    most = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // rows_per_block))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "key"))
    numbered = placed.withColumn("nth", within).join(offsets, ["shard", "block"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
