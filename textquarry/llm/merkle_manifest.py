"""Merkle manifest of a dataset: a hash tree per part of the data, one over the parts, stored in a van Emde Boas layout.

A leaf is the SHA-256 of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value. Within a tree, leaves
ascend by key; every two consecutive nodes become the hash of their hex digests, a lone last one the hash of its own, until one is
left. The roots of all trees, ordered by the part's name (null first, bytewise), are the leaves of a tree of their own.

Aligned subtrees of ``2 ** HEIGHT`` leaves are blocks; a block is one row. Its digests lie in one array in van Emde Boas order: a tree
of ``h`` levels is split at half height into a top and its bottom subtrees, each of which lies in one piece and is split in the same
way. ``addresses`` gives the place of every node by that arithmetic alone; building a block and looking up siblings both go by it. The
roots of the blocks are the leaves of the next layer of blocks, and so on until a tree has one block, so no task holds more than a
block, and a layer is 2 ** HEIGHT times shorter than the one below.

Only keys and digests move: once to sort by key (by range, so one part with most rows is spread), once to their blocks. Each text is
hashed where it is read.

Nulls: null fields hash as ``-``; null keys come first in their tree; rows without a part (null) have a tree of their own, the first.
Repeated keys are ordered by their leaf; repeated rows are leaves of their own with equal digests. Empty texts count zero bytes, very
long ones are hashed in whole. Columns other than the named ones are not read, whatever their names. An empty table has no tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.common import map_batches, stored

HEIGHT = 10  # a block has at most 1,024 leaves
DIGEST = 32
RANGE_ROWS = 2_000_000  # leaves that a task sorts
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = DIGEST + 1  # a step of a path: which side the sibling is on (0: none), and its digest
_NONE, _LEFT, _RIGHT = 0, 1, 2
TOP = "top"  # the tree over all trees; those of parts begin with "=", that of null is ""

BLOCK = "tree string, layer int, block long, n int, levels int, nodes binary"


# --- leaves -------------------------------------------------------------------------------------------------------


def leaf_of(*values: Column) -> Column:
    """Hex digest of the fields of a row."""
    fields = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]), 256)


# --- the layout of a block ----------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Places of the nodes of a complete tree of ``levels`` levels, one array per depth from the root on."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top = levels // 2
    bottom = levels - top
    size = (1 << bottom) - 1
    begins = ((1 << top) - 1) + np.arange(1 << top, dtype=np.int64) * size  # each bottom subtree lies in one piece
    below = tuple((begins[:, None] + places[None, :]).ravel() for places in addresses(bottom))
    return addresses(top) + below


@lru_cache(maxsize=64)
def _offsets(levels: int) -> tuple[list[int], ...]:
    return tuple((places * DIGEST).tolist() for places in addresses(levels))


def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _parent(left: bytes, right: bytes | None) -> bytes:
    return _hash((left.hex() + right.hex() if right is not None else left.hex()).encode())


def levels_of(n: int, single: bool) -> int:
    """Levels of a block of ``n`` leaves: all of them, unless its tree has no other block in this layer."""
    return max(n - 1, 0).bit_length() + 1 if single else HEIGHT + 1


class Block:
    """An aligned subtree: digests in one array, found by address. ``n`` leaves are there, the nodes beyond them are not."""

    def __init__(self, n: int, levels: int, nodes: bytes | bytearray):
        self.n, self.levels, self.nodes, self.at = n, levels, nodes, _offsets(levels)

    @classmethod
    def built(cls, leaves: list[bytes], single: bool) -> Block:
        levels = levels_of(len(leaves), single)
        block = cls(len(leaves), levels, bytearray(DIGEST * ((1 << levels) - 1)))
        for i, digest in enumerate(leaves):
            block._put(levels - 1, i, digest)
        for depth in range(levels - 2, -1, -1):
            there = block.count(depth + 1)
            for i in range(block.count(depth)):
                right = block.node(depth + 1, 2 * i + 1) if 2 * i + 1 < there else None
                block._put(depth, i, _parent(block.node(depth + 1, 2 * i), right))
        return block

    def count(self, depth: int) -> int:
        """Nodes at a depth that have a leaf below them."""
        height = self.levels - 1 - depth
        return -(-self.n // (1 << height))

    def _put(self, depth: int, i: int, digest: bytes) -> None:
        at = self.at[depth][i]
        self.nodes[at : at + DIGEST] = digest

    def node(self, depth: int, i: int) -> bytes:
        at = self.at[depth][i]
        return bytes(self.nodes[at : at + DIGEST])

    def root(self) -> bytes:
        return self.node(0, 0)

    def path(self, i: int) -> bytes:
        """The siblings from a leaf up to the root of the block, a step each."""
        steps = []
        for depth in range(self.levels - 1, 0, -1):
            other = i ^ 1
            if other >= self.count(depth):
                steps.append(bytes([_NONE]) + bytes(DIGEST))
            else:
                steps.append(bytes([_LEFT if other < i else _RIGHT]) + self.node(depth, other))
            i >>= 1
        return b"".join(steps)


def siblings(path: bytes) -> list[bytes]:
    return [path[i + 1 : i + STEP] for i in range(0, len(path), STEP) if path[i] != _NONE]


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    for i in range(0, len(path), STEP):
        other = path[i + 1 : i + STEP]
        side = path[i]
        digest = _parent(other, digest) if side == _LEFT else _parent(digest, other if side == _RIGHT else None)
    return digest


# --- building -----------------------------------------------------------------------------------------------------


def _numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Add ``at``: the place of every row within its ``tree``, from 0 without gaps.

    Rows are dealt out by ranges of the order and sorted there; equal rows are told apart by a random number, so a tree or a key of any
    size is spread. What is added up is one row per range and tree. ``leaves`` is read twice (ranges are found by a sample).
    """
    parts = max(leaves.count() // RANGE_ROWS, leaves.sparkSession.sparkContext.defaultParallelism)
    keys = ["tree", *order, "_salt"]
    salted = leaves.withColumn("_salt", F.rand(17))
    sorted_ = salted.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys).drop("_salt")
    mark = F.monotonically_increasing_id()
    held = stored(sorted_.withColumn("_mark", mark), "sorted-leaves")
    part, place = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    held = held.withColumns({"_part": part, "_place": place}).drop("_mark")
    runs = held.groupBy("tree", "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return held.join(stored(starts, "starts"), ["tree", "_part"]).withColumn("at", F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")


def _grouped(leaves: DataFrame, sizes: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """One row per block: its number, whether it is its tree's only one, and its leaves in order (a bounded number)."""
    row = F.struct("at", "digest", *carry)
    keyed = leaves.withColumn("block", F.shiftright("at", HEIGHT))
    blocks = keyed.groupBy("tree", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return blocks.join(sizes, "tree").withColumn("single", F.col("size") <= 1 << HEIGHT)


def _build(batches: Iterator[pa.RecordBatch], layer: int, carry: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):  # a block at a time
            rows = batch.column(3).slice(r, 1).flatten()
            leaves = [bytes.fromhex(d) for d in rows.field(1).to_pylist()]
            block = Block.built(leaves, batch.column(2)[r].as_py())
            made = [
                batch.column(0).slice(r, 1), pa.array([layer], pa.int32()), batch.column(1).slice(r, 1), pa.array([block.n], pa.int32()),
                pa.array([block.levels], pa.int32()), pa.array([bytes(block.nodes)], pa.binary()), pa.array([block.root().hex()], pa.string()),
            ]
            one = pa.array([0, len(rows)], pa.int32())
            held = [pa.ListArray.from_arrays(one, rows.field(2 + k)) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*made, *held], ["tree", "layer", "block", "n", "levels", "nodes", "digest", *carry])


@dataclass(frozen=True)
class Manifest:
    """The layers of blocks, lowest first. The first holds the rows' trees; the last of ``layers`` has one block per tree; ``top``
    are the layers of the tree over them. ``carry`` names the columns that the lowest blocks hold, a list each, in leaf order."""

    layers: list[DataFrame]
    top: list[DataFrame]
    carry: tuple[str, ...]

    def subroots(self) -> DataFrame:
        """``tree, digest`` of every part."""
        return reduce(DataFrame.unionByName, [d.where("single").select("tree", "digest") for d in self.layers])

    def root(self) -> str | None:
        row = self.top[-1].select("digest").first() if self.top else None
        return row[0] if row else None


def _layers(leaves: DataFrame, name: str, carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """Blocks over ``tree, at, digest`` rows, and over their roots, until each tree has one block. Each layer is written once."""
    out, now, held = [], leaves, carry
    while True:
        sizes = stored(now.groupBy("tree").agg(F.count(F.lit(1)).alias("size")), "sizes")
        grouped = _grouped(now, sizes, held).select("tree", "block", "single", "rows")
        layer, lists = len(out), held

        def work(batches, layer=layer, lists=lists):
            yield from _build(batches, layer, lists)

        types = {f.name: f.dataType.simpleString() for f in now.schema.fields}
        schema = BLOCK + ", digest string" + "".join(f", {c} array<{types[c]}>" for c in lists)
        built = map_batches(grouped, work, schema)
        blocks = stored(built, f"{name}-blocks", "zstd")
        several = stored(blocks.groupBy("tree").agg((F.count(F.lit(1)) == 1).alias("single")), "several")
        out.append(blocks.join(several, "tree"))
        left = several.where("not single")
        if left.isEmpty():
            return out
        now = blocks.join(left.select("tree"), "tree", "left_semi").select("tree", F.col("block").alias("at"), "digest")
        held = ()


def build_manifest(leaves: DataFrame, carry: tuple[str, ...] = ()) -> Manifest:
    """The trees of ``tree, key, digest`` rows (and the columns to carry): by ``tree``, ascending by key, then by digest."""
    held = stored(leaves.select("tree", "key", "digest", *carry), "leaves")
    numbered = _numbered(held, ["key", "digest"]).drop("key")
    layers = _layers(numbered, "tree", carry)
    parts = Manifest(layers, [], carry).subroots().select(F.lit(TOP).alias("tree"), F.col("tree").alias("part"), "digest")
    named = _numbered(stored(parts, "parts"), ["part"])
    return Manifest(layers, _layers(named.withColumnRenamed("part", "name"), "top", ("name",)), carry)


def _descend(batches: Iterator[pa.RecordBatch], n_lists: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the path above each to the path above each of their leaves."""
    for batch in batches:
        for r in range(batch.num_rows):
            block = Block(*(batch.column(c)[r].as_py() for c in ("n", "levels", "nodes")))
            above = batch.column("above")[r].as_py()
            begin = batch.column("block")[r].as_py() << HEIGHT
            paths = pa.array([block.path(i) + above for i in range(block.n)], pa.binary())
            tree = pa.array([batch.column("tree")[r].as_py()] * block.n, pa.string())
            at = pa.array(np.arange(begin, begin + block.n))
            lists = [batch.column(batch.num_columns - n_lists + k).slice(r, 1).flatten() for k in range(n_lists)]
            names = batch.schema.names[batch.num_columns - n_lists :] if n_lists else []
            yield pa.RecordBatch.from_arrays([tree, at, paths, *lists], ["tree", "block", "above", *names])


def _lists(blocks: DataFrame, carry: tuple[str, ...]) -> str:
    types = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema.fields if f.name in carry}
    return "".join(f", {c} {types[c]}" for c in carry)


def above_blocks(manifest: Manifest) -> list[DataFrame]:
    """For each layer, its blocks with ``above``: the path from the block's root to the root over all parts.

    From the top down: a layer hands each block of the one below its path. These are thin rows, one per block.
    """
    paths = None
    for blocks in reversed(manifest.top):
        held = ("name",) if "name" in blocks.columns else ()
        upper = blocks.withColumn("above", F.lit(b"")) if paths is None else blocks.join(paths, ["tree", "block"])
        chosen = upper.select("tree", "block", "n", "levels", "nodes", "above", *held)

        def work(batches, k=len(held)):
            yield from _descend(batches, k)

        paths = map_batches(chosen, work, "tree string, block long, above binary" + _lists(blocks, held))
    whole = stored(paths.select(F.col("name").alias("tree"), "above"), "paths")
    out, handed = [], None
    for blocks in reversed(manifest.layers):
        single = blocks.where("single").join(whole, "tree")
        upper = single if handed is None else single.unionByName(blocks.where("not single").join(handed, ["tree", "block"]))
        out.append(upper)
        chosen = upper.select("tree", "block", "n", "levels", "nodes", "above")

        def work(batches):
            yield from _descend(batches, 0)

        handed = stored(map_batches(chosen, work, "tree string, block long, above binary"), "paths") if len(out) < len(manifest.layers) else None
    return out[::-1]


PROOF = "tree string, leaf string, subroot string, proof_sha256 string, folded_root string, claimed string"


def _check(batches: Iterator[pa.RecordBatch], carry: tuple[str, ...], claim: str | None) -> Iterator[pa.RecordBatch]:
    """Blocks with their paths to one row per leaf: its proof, and the root that its claimed digest gives along it."""
    for batch in batches:
        for r in range(batch.num_rows):
            block = Block(*(batch.column(c)[r].as_py() for c in ("n", "levels", "nodes")))
            above = batch.column("above")[r].as_py()
            rest = [s.hex() for s in siblings(above)]
            lists = {c: batch.column(c).slice(r, 1).flatten() for c in carry}
            claims = lists[claim].to_pylist() if claim else [None] * block.n
            known: dict[bytes, bytes] = {}  # root of the block as claimed, to the root over all: most are the same
            leaves, proofs, folded = [], [], []
            for i, said in enumerate(claims):
                leaf, path = block.node(block.levels - 1, i), block.path(i)
                mine = fold(bytes.fromhex(said) if said else leaf, path)
                if mine not in known:
                    known[mine] = fold(mine, above)
                leaves.append(leaf.hex())
                proofs.append(_hash("".join([s.hex() for s in siblings(path)] + rest).encode()).hex())
                folded.append(known[mine].hex())
            same = lambda c: pa.array([batch.column(c)[r].as_py()] * block.n, pa.string())
            made = [same("tree"), pa.array(leaves), same("subroot"), pa.array(proofs), pa.array(folded), pa.array(claims, pa.string())]
            names = ["tree", "leaf", "subroot", "proof_sha256", "folded_root", "claimed", *[c for c in carry if c != claim]]
            yield pa.RecordBatch.from_arrays([*made, *[lists[c] for c in carry if c != claim]], names)


def prove(manifest: Manifest, claim: str | None = None) -> DataFrame:
    """One row per leaf: ``tree, leaf, subroot, proof_sha256, folded_root, claimed`` and the carried columns.

    ``claim`` names a carried column with the digest that a row is said to have (null: its own); ``folded_root`` is the root that
    this digest gives with the manifest's siblings, so it is the true root if and only if the claim holds.
    """
    subroots = stored(manifest.subroots().withColumnRenamed("digest", "subroot"), "subroots")
    lowest = above_blocks(manifest)[0].join(subroots, "tree")
    carry = manifest.carry
    others = tuple(c for c in carry if c != claim)
    chosen = lowest.select("tree", "n", "levels", "nodes", "above", "subroot", *carry)
    return map_batches(chosen, lambda batches: _check(batches, carry, claim), PROOF + _lists(lowest, others))


# --- documents ----------------------------------------------------------------------------------------------------


def _tree_of(part: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit(""))


def document_leaves(docs: DataFrame, part: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, **more: Column) -> DataFrame:
    """``tree, key, digest`` of every document and further columns; the texts are read here and nowhere else."""
    digest = leaf_of(*[F.col(f"`{f}`") for f in fields])
    return docs.select(_tree_of(F.col(part)).alias("tree"), F.col(key).cast("long").alias("key"), digest.alias("digest"), *[c.alias(n) for n, c in more.items()])


def tampered_leaf(fields: tuple[str, ...] = FIELDS, count: str = "n_chars", key: str = "doc_id", every: int = 7) -> Column:
    """The digest of a row whose ``count`` is one too high, for the keys whose CRC-32 ``every`` divides; null for all others."""
    hit = F.crc32(F.col(key).cast("long").cast("string").cast("binary")) % every == 0
    changed = [F.col(f"`{f}`") + 1 if f == count else F.col(f"`{f}`") for f in fields]
    return F.when(hit, leaf_of(*changed))


def audit(docs: DataFrame) -> DataFrame:
    """Manifest of the documents, and each one checked against it after the tampering of ``tampered_leaf``."""
    leaves = document_leaves(docs, doc_id=F.col("doc_id").cast("long"), said=tampered_leaf())
    manifest = build_manifest(leaves, ("doc_id", "said"))
    root = F.lit(manifest.root()).cast("string")
    return prove(manifest, "said").select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


# --- files --------------------------------------------------------------------------------------------------------


def write_manifest(manifest: Manifest, folder: str) -> None:
    """The blocks of all layers as one Parquet table, partitioned by kind of tree and layer."""
    kinds = [(kind, blocks) for kind, layers in (("part", manifest.layers), ("top", manifest.top)) for blocks in layers]
    every = [blocks.withColumn("kind", F.lit(kind)) for kind, blocks in kinds]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)
    whole.write.partitionBy("kind", "layer").parquet(folder, compression="zstd")


def read_manifest(spark: SparkSession, folder: str, carry: tuple[str, ...] = ()) -> Manifest:
    """A manifest as written; ``carry`` names the columns it carries."""
    whole = spark.read.parquet(folder)
    there = {(r.kind, r.layer) for r in whole.select("kind", "layer").distinct().collect()}  # a few rows

    def layers(kind: str) -> list[DataFrame]:
        found = [whole.where((F.col("kind") == kind) & (F.col("layer") == i)) for i in range(sum(k == kind for k, _ in there))]
        held = carry if kind == "part" else ("name",)
        return [b.drop("kind", *[c for c in (*carry, "name") if i or c not in held]) for i, b in enumerate(found)]

    return Manifest(layers("part"), layers("top"), carry)
