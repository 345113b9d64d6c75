"""SimHash near-duplicates: 64-bit fingerprints, pigeonring candidates, exact links, connected groups.

Two fingerprints link at ``BUDGET`` (4) or fewer differing bits. Cut into eight segments of eight bits on a ring, a linked pair has
a start segment from which every chain of l consecutive segments differs in at most l * 4 / 8 bits (the pigeonring principle). So
from that start: the first segment is equal, at most one bit differs in the first three, at most two in the first five. Hence two
more of the next four segments are equal, and unless the next two both are, one of each half is: five ways. A fingerprint is filed
under eight starts times five ways, with the 24 bits that must agree as key. Fingerprints that share a key are candidates; the
chain budgets of all eight lengths prune them before the full Hamming check.

Equal fingerprints are one node, so a group of copies of any size is one row here. Within a key only a spanning forest of the links
is emitted, never all pairs. A key that holds more than ``max_bucket`` fingerprints is filed anew: of the 40 bits outside the key,
in eight parts of five, four parts must be equal, in 70 ways; such a subkey holds at most 2^20 fingerprints whatever the input.

Nulls: a null or wordless text has fingerprint zero, which links like any other. A null document id takes part, but does not name a
group unless all ids in it are null. Repeated rows share a fingerprint. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_batches, stored
from textquarry.llm.components import components

BUDGET = 4
SEGMENTS = 8
SHINGLE = 4
_UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
# Segments, counted from the start, that a key holds besides the start itself.
WAYS = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4))


def fingerprint(text: str | None) -> int:
    """The bits set in more than half of the hashes of the four-word shingles of a text."""
    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    width = min(SHINGLE, len(tokens))
    begins = np.concatenate(([0], ends[: len(tokens) - width])).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(begins)
    stops = (ends[width - 1 :] - 1).tolist()
    for i in range(0, n, 1 << 16):  # a bounded number of hashes at a time
        hashes = np.fromiter(
            (digest(view[a:b], 42) for a, b in zip(begins[i : i + (1 << 16)], stops[i : i + (1 << 16)])), "<u8"
        )
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "fp") -> DataFrame:
    """``doc_id``, the fingerprint as a signed long, and a tag that tells texts of the same id apart."""

    def work(batches):
        for batch in batches:
            found = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "tag", into])

    key = F.col(doc_id).cast("long")
    held = docs.select(key.alias("doc_id"), F.col(text).alias("body"), F.xxhash64(key, F.col(text)).alias("tag"))
    return map_batches(held, work, f"doc_id long, tag long, {into} long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (i % SEGMENTS)).bitwiseAND(F.lit(0xFF))


def filed(nodes: DataFrame) -> DataFrame:
    """Each fingerprint under its forty keys: start and way in the upper bits, the 24 agreeing bits below."""
    fp, keys = F.col("fp"), []
    for start in range(SEGMENTS):
        for w, way in enumerate(WAYS):
            at = [start, *(start + x for x in way)]
            bits = F.shiftleft(F.lit(start * len(WAYS) + w).cast("long"), 24)
            for place, i in enumerate(at):
                bits = bits.bitwiseOR(F.shiftleft(_segment(fp, i), 8 * place))
            keys.append(bits)
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _linked(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences pass the chain budgets from their start segment, and then the full Hamming check."""
    each = np.bitwise_count(x.view(np.uint8).reshape(-1, SEGMENTS))
    ring = (start[:, None] + np.arange(SEGMENTS)) % SEGMENTS
    chain = np.cumsum(np.take_along_axis(each, ring, axis=1), axis=1, dtype=np.int64)
    budget = np.arange(1, SEGMENTS + 1) * BUDGET // SEGMENTS
    ok = (chain <= budget).all(axis=1)
    ok[ok] = np.bitwise_count(x[ok]) <= BUDGET
    return ok


def _forest(fps: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of one key's links, breadth first: each fingerprint is compared with those not reached yet."""
    rest = fps
    while len(rest) > 1:
        frontier, rest = [rest[:1]], rest[1:]
        while frontier and len(rest):
            wave = frontier.pop()
            for node in wave:
                if not len(rest):
                    break
                hit = np.bitwise_count(rest ^ node) <= BUDGET
                at = np.flatnonzero(hit)
                if len(at):
                    ok = at[_linked(rest[at] ^ node, np.full(len(at), start))]
                    if len(ok):
                        yield np.full(len(ok), node), rest[ok]
                        frontier.append(rest[ok])
                        rest = np.delete(rest, ok)


def _links_of(keys: np.ndarray, fps: np.ndarray, start: np.ndarray, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within the keys of sorted, complete buckets: small buckets by shifted comparison, larger ones as forests."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((edge, [len(keys)])))
    left, right = [], []
    width = np.repeat(size, size)
    place = np.arange(len(keys)) - np.repeat(edge, size)
    for shift in range(1, small):
        at = np.flatnonzero((width <= small) & (place + shift < width))
        if not len(at):
            break
        ok = at[_linked(fps[at] ^ fps[at + shift], start[at])]
        left.append(fps[ok])
        right.append(fps[ok + shift])
    for e, n in zip(edge[size > small], size[size > small]):
        for a, b in _forest(fps[e : e + n], int(start[e])):
            left.append(a)
            right.append(b)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def _bucket_links(start_of, max_bucket: int):
    """Stream sorted ``(fp, key[, start])`` rows, holding the last, unfinished bucket over; too large buckets come out unlinked."""

    def work(batches):
        held_keys, held_fps, held_start = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        passing = None  # the key of a too large bucket whose rows are handed on

        def out(a, b, whole):
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), whole))], ["u", "v", "refile"]
            )

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            keys = np.concatenate((held_keys, columns[1]))
            fps = np.concatenate((held_fps, columns[0].view(np.uint64)))
            start = np.concatenate((held_start, start_of(columns)))
            if passing is not None:
                n = int(np.searchsorted(keys, passing, side="right"))
                if n:
                    yield out(fps[:n], keys[:n].view(np.uint64), True)
                keys, fps, start = keys[n:], fps[n:], start[n:]
                if not len(keys):
                    held_keys, held_fps, held_start = keys, fps, start
                    continue
                passing = None
            cut = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
            edge = np.flatnonzero(np.concatenate(([True], keys[1:cut] != keys[: cut - 1]))) if cut else np.zeros(0, np.int64)
            size = np.diff(np.concatenate((edge, [cut]))) if cut else edge
            big = np.repeat(size > max_bucket, size)
            if big.any():
                yield out(fps[:cut][big], keys[:cut][big].view(np.uint64), True)
            if cut and not big.all():
                yield out(*_links_of(keys[:cut][~big], fps[:cut][~big], start[:cut][~big]), False)
            held_keys, held_fps, held_start = keys[cut:], fps[cut:], start[cut:]
            if len(held_keys) > max_bucket:
                yield out(held_fps, held_keys.view(np.uint64), True)
                passing = held_keys[0]
                held_keys, held_fps, held_start = held_keys[:0], held_fps[:0], held_start[:0]
        if len(held_keys):
            yield out(*_links_of(held_keys, held_fps, held_start), False)

    return work


EDGES = "u long, v long, refile boolean"


def _refiled(rows: DataFrame) -> DataFrame:
    """Fingerprints of too large keys under seventy subkeys each: four of eight five-bit parts outside the key's own 24 bits."""
    parts = list(combinations(range(8), 4))

    def work(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            key = batch.column(1).to_numpy()
            combo = key >> 24
            start = combo // len(WAYS)
            inside = np.zeros((len(fps), SEGMENTS), bool)
            inside[np.arange(len(fps)), start] = True
            for w, way in enumerate(WAYS):
                mine = np.flatnonzero(combo % len(WAYS) == w)
                for x in way:
                    inside[mine, (start[mine] + x) % SEGMENTS] = True
            outer = np.argsort(inside, axis=1, kind="stable")[:, : SEGMENTS - 3]  # the five segments outside the key
            rest = np.zeros(len(fps), np.uint64)
            each = fps.view(np.uint8).reshape(-1, SEGMENTS)
            for place in range(SEGMENTS - 3):
                rest |= np.take_along_axis(each, outer[:, place : place + 1], axis=1)[:, 0].astype(np.uint64) << np.uint64(8 * place)
            for n, four in enumerate(parts):
                sub = np.full(len(fps), n, np.int64)
                for p in four:
                    sub = sub << 5 | (rest >> np.uint64(5 * p) & np.uint64(31)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sub)], ["fp", "key", "sub"])

    return rows.mapInArrow(work, "fp long, key long, sub long")


def links(nodes: DataFrame, max_bucket: int = 1 << 16) -> DataFrame:
    """``(u, v)``: links of distinct fingerprints that connect exactly what all links connect. ``nodes``: distinct ``fp``."""
    ways = len(WAYS)
    keyed = filed(nodes).repartition("key").sortWithinPartitions("key", "fp")
    found = stored(map_batches(keyed, _bucket_links(lambda c: (c[1] >> 24) // ways, max_bucket), EDGES), "links")
    edges = found.where("not refile").select("u", "v")
    large = found.where("refile").select(F.col("u").alias("fp"), F.col("v").alias("key"))
    if large.limit(1).count():
        # A subkey is 27 bits and goes with the key's 30 into one long; its start is the key's.
        again = _refiled(large).select("fp", F.shiftleft("key", 27).bitwiseOR(F.col("sub")).alias("key"))
        again = again.repartition("key").sortWithinPartitions("key", "fp")
        rest = map_batches(again, _bucket_links(lambda c: (c[1] >> 51) // ways, 1 << 21), EDGES)
        edges = edges.unionByName(rest.select("u", "v"))
    return edges.dropDuplicates()


def grouped(prints: DataFrame) -> DataFrame:
    """From ``doc_id, fp`` per document: ``fp, root`` (the group's least fingerprint) and ``component_id`` of each fingerprint."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "groups")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.select("fp", "root").join(ids, "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    prints = stored(fingerprints(docs, doc_id, text), "fingerprints")
    groups = grouped(prints.select("doc_id", "fp")).select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the least doc_id, then the least text tag. Own columns only.

    Who stays is decided on thin rows; texts move once, to meet the ids that stay and to drop repeated equal rows there.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    groups = grouped(prints.select("doc_id", "fp")).select("fp", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    return staying(docs, prints.join(groups, "fp").groupBy("root").agg(F.min(order).alias("best")))


def staying(docs: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``best`` names by id and text tag, one of repeated equal rows."""
    stay = best.select(F.col("best.tag").alias("tag_"), F.coalesce("best.doc_id", F.lit(0)).alias("id_"))
    key = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(key, F.lit(0)).alias("id_"), F.xxhash64(key, F.col("text")).alias("tag_"))
    return rows.join(stay, ["id_", "tag_"], "left_semi").dropDuplicates(["id_", "tag_"]).select("row.*")
