"""Near copies by resemblance: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

Candidates come from two sides. Fingerprints of four or fewer differing bits are found by pigeonring keys, chain budgets and Hamming
check (see ``simhash.links``). At a similarity of 0.8, though, two fingerprints differ in about ten bits, too many for keys that must
agree; such pairs come from bands of least hashes: a document has ``BANDS`` keys of ``ROWS`` least shingle hashes each,
and a pair at similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS, which is 0.99997 at 0.8. Candidates whose sizes rule
0.8 out, or whose fingerprints differ in more than ``FAR`` bits (expected are 10 of 64, with a deviation of 3), are not looked
at; all others are compared by their exact sets. Only pairs that pass link, and groups are connected by links.

Equal token sequences are one node, so a group of copies of any size is one row here. First every node is compared with one leader of
its keys. Then, within each key that still holds several groups, the rows outside the largest group are held with their sets, and
every candidate of another group meets them there until their groups are joined: only links leave a key, never its pairs.

Nulls: null and wordless texts are copies of each other. A null document id stays only if all ids in its group are null. Repeated rows
are one node. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import map_batches, stored
from textquarry.llm.components import components
from textquarry.llm.simhash import LOWER, links as fingerprint_links, staying

SHINGLE = 5
SIMILAR = (4, 5)
BANDS, ROWS, FAR = 20, 4, 24
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shingles(tokens: list[bytes]) -> np.ndarray:
    """The distinct hashes of all shingles; a shorter text is one shingle, an empty one none."""
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    width = min(SHINGLE, len(tokens))
    begins = np.concatenate(([0], ends[: len(tokens) - width])).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(view[a:b], 42) for a, b in zip(begins, (ends[width - 1 :] - 1).tolist())), np.uint64, len(begins)))


def sketch(hashes: np.ndarray) -> tuple[int, list[int]]:
    """SimHash fingerprint and band keys of a set of shingles, as signed longs."""
    if not len(hashes):
        return 0, []
    total, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 2048):
        part = hashes[i : i + 2048]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        np.minimum(least, ((part ^ _MIX[0]) * _MIX[1]).min(axis=1), out=least)
    fp = int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])
    keys = [xxhash.xxh64_intdigest(band.tobytes(), b) for b, band in enumerate(least.reshape(BANDS, ROWS))]
    return fp, np.array(keys, np.uint64).view(np.int64).tolist()


def _node(tokens: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(tokens), 7)).view(np.int64))


def _sketches(batches):
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            tokens = tokens_of(text)
            hashes = shingles(tokens)
            rows.append((_node(tokens), len(hashes), *sketch(hashes)))
        node, n, fp, keys = zip(*rows) if rows else ((), (), (), ())
        made = [pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "tag", "node", "n", "fp", "keys"])


def _sets(batches):
    for batch in batches:
        for text in batch.column(0).to_pylist():  # a row at a time: sets are larger than texts
            tokens = tokens_of(text)
            made = [pa.array([_node(tokens)], pa.int64()), pa.array([shingles(tokens).view(np.int64)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, ["node", "hashes"])


def _may_be(n: Column, fp: Column, other_n: Column, other_fp: Column) -> Column:
    part, whole = SIMILAR
    return (F.bit_count(fp.bitwiseXOR(other_fp)) <= FAR) & (whole * F.least(n, other_n) >= part * F.greatest(n, other_n))


class _Held:
    """The rows of one key outside its largest group, each with its set."""

    def __init__(self):
        self.n, self.fp, self.group, self.node, self.sets = np.zeros(16, np.int64), np.zeros(16, np.uint64), np.zeros(16, np.int64), [], []
        self.joined: dict[int, int] = {}

    def meet(self, node: int, n: int, fp: int, group: int, hashes: np.ndarray, large: bool):
        """Links of a row to rows held, at most one for each group that is not joined yet; the row is held unless ``large``."""
        while group in self.joined:
            group = self.joined[group]
        k, (part, whole) = len(self.node), SIMILAR
        far = np.bitwise_count(self.fp[:k] ^ fp)
        ok = (self.group[:k] != group) & (far <= FAR) & (whole * np.minimum(self.n[:k], n) >= part * np.maximum(self.n[:k], n))
        at = np.flatnonzero(ok)
        for i in at[np.argsort(far[at], kind="stable")]:
            other = self.group[i]
            if other == group:
                continue
            mine = self.sets[i]
            common = int((mine[np.minimum(np.searchsorted(mine, hashes), len(mine) - 1)] == hashes).sum())
            if (whole + part) * common >= part * (n + len(mine)):
                yield self.node[i], node
                self.joined[int(other)] = group
                self.group[:k][self.group[:k] == other] = group
        if not large:
            if k == len(self.n):
                self.n, self.fp, self.group = (np.concatenate((x, x)) for x in (self.n, self.fp, self.group))
            self.n[k], self.fp[k], self.group[k] = n, fp, group
            self.node.append(node)
            self.sets.append(hashes)


def _late_links(batches):
    """Stream rows sorted by key, those of a key's largest group last; only the others are held."""
    key, held = None, _Held()
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]]
        sets, found = batch.column(6), []
        for i, (new, large, node, n, fp, group) in enumerate(zip(*columns)):
            if new != key:
                key, held = new, _Held()
            hashes = sets[i].values.to_numpy().view(np.uint64)
            found += held.meet(int(node), int(n), fp.view(np.uint64), int(group), hashes, bool(large))
        u, v = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose exact similarity is high enough."""
    part, whole = SIMILAR
    held = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    common, both = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return held.where((whole + part) * common >= part * both).select("u", "v")


def _texts(docs: DataFrame) -> DataFrame:
    key = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(key, F.lit(0)).alias("id_"), F.xxhash64(key, F.col("text")).alias("tag_"), F.col("text").alias("body"))


def pigeonring(nodes: DataFrame) -> DataFrame:
    """``(u, v)``: candidates by fingerprint. Equal ones meet at the least node; those of ``BUDGET`` or fewer differing bits are connected
    by links between these. Nodes without words have no fingerprint of their own."""
    worded = nodes.where("n > 0").select("node", "fp")
    heads = stored(worded.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = worded.join(heads, "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    u, v = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in "uv")
    near = fingerprint_links(heads.select("fp")).join(u, "u").join(v, "v")
    return stored(equal.unionByName(near.select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))), "pigeonring")


def similar(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(u, v)``: links that connect what all pairs of similar nodes connect. ``nodes``: ``node, id_, tag_, n, fp, keys``."""
    filed = nodes.select(F.explode("keys").alias("key"), "node", "n", "fp")
    within = Window.partitionBy("key")
    leader = F.min(F.struct("node", "n", "fp")).over(within)
    shared = stored(filed.withColumn("leader", leader).withColumn("size", F.count(F.lit(1)).over(within)).where("size > 1"), "shared")
    near = shared.where("node <> leader.node").where(_may_be(F.col("n"), F.col("fp"), F.col("leader.n"), F.col("leader.fp")))
    close = pigeonring(nodes)
    first = near.groupBy(F.col("node").alias("v")).agg(F.min("leader.node").alias("u")).select("u", "v")
    first = stored(first.unionByName(close).distinct(), "pairs")
    paired = shared.select("node").unionByName(close.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    wanted = nodes.join(paired, "node", "left_semi").select("id_", "tag_")
    texts = _texts(docs).join(wanted, ["id_", "tag_"], "left_semi").select("body")
    sets = stored(map_batches(texts, _sets, "node long, hashes array<long>").dropDuplicates(["node"]), "sets")
    links = stored(_verified(first, sets), "links")
    groups = components(links)
    named = shared.join(groups, "node", "left").select("key", "node", "n", "fp", F.coalesce("root", "node").alias("group"))
    named = named.withColumn("weight", F.struct(F.count(F.lit(1)).over(Window.partitionBy("key", "group")), "group"))
    mixed = named.withColumn("most", F.max("weight").over(within)).withColumn("low", F.min("group").over(within)).withColumn("high", F.max("group").over(within))
    mixed = stored(mixed.where("low <> high").select("key", (F.col("weight") == F.col("most")).alias("large"), "node", "n", "fp", "group"), "mixed")
    held = mixed.join(sets, "node").select("key", "large", "node", "n", "fp", "group", "hashes")
    more = map_batches(held.repartition("key").sortWithinPartitions("key", "large"), _late_links, "u long, v long")
    return links.unionByName(stored(more, "links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the least doc_id, then the least text tag. Own columns only."""
    key = F.col("doc_id").cast("long")
    held = docs.select(key.alias("doc_id"), F.xxhash64(key, F.col("text")).alias("tag"), F.col("text").alias("body"))
    prints = map_batches(held, _sketches, "doc_id long, tag long, node long, n long, fp long, keys array<long>")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    best = prints.groupBy("node").agg(F.min(order).alias("best"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")])
    nodes = stored(best.select("*", F.coalesce("best.doc_id", F.lit(0)).alias("id_"), F.col("best.tag").alias("tag_")), "nodes")
    roots = components(similar(docs, nodes.select("node", "id_", "tag_", "n", "fp", "keys")))
    named = nodes.select("node", "best").join(roots, "node", "left").select("best", F.coalesce("root", "node").alias("root"))
    return staying(docs, named.groupBy("root").agg(F.min("best").alias("best")))
