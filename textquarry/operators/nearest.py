"""Exact nearest neighbours of a batch of queries, without ever forming the pairs as rows.

Each task streams its chunks through Arrow batches, computes one block of scores at a time as a matrix product and
keeps only the k best per query, so a task emits k rows per query whatever the size of the corpus. A window then ranks
these few rows. Ties are broken by id everywhere, so the result does not depend on the partitioning.

Scores are single floats with a bound on their error: what they cannot rule out is measured in double precision, and
that distance alone decides.

A query batch is sent to the tasks only after its size has been checked. Of a larger one, blocks of queries and blocks of
rows are packed by the executors, and every block of queries meets every block of rows in one cartesian product of
blocks: rows and queries move once, and the driver sees neither.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.vectors import COMPARE_DIGITS
from textquarry.session import apply_defaults, materialize

MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 128 * 1024 * 1024
MAX_HELD_HITS = 200_000  # k hits per query that one task may hold
BLOCK_CELLS = 1_000_000  # scores computed at a time
BLOCK_ROWS = 4096  # rows packed to one block, if they hold no more than
BLOCK_BYTES = 2 * 1024 * 1024
DENSE = 32  # rows per probed value below which a batch is multiplied whole


class _Best:
    """The k nearest rows per query among those seen so far, with the columns that belong to them."""

    def __init__(self, queries: np.ndarray, k: int, key: list[str]):
        self.queries, self.k = queries, k
        self.ties = ["id", *[c for c in key if c != "id"]]
        self.lengths = np.einsum("ij,ij->i", queries, queries)
        # A row's score, its product with the query less half its square, is the greater the nearer it is.
        self.sides = {np.float64: np.concatenate((queries, np.ones((len(queries), 1))), axis=1)}
        self.norms = np.sqrt(self.lengths + 1.0)
        self.limit = np.full(len(queries), np.inf)  # at least the distance of the k-th best so far
        self.query = np.empty(0, dtype=np.int64)
        self.distance = np.empty(0)
        self.rows: pa.Table | None = None
        self.pending: list[tuple[np.ndarray, np.ndarray, pa.Table]] = []
        self.waiting = 0

    def offer(self, vectors: np.ndarray, rows: pa.Table, among: np.ndarray | None = None, seen: np.ndarray | None = None) -> None:
        """``among``: the queries that look at these rows; ``seen``: for every query, at which of them it looks."""
        step = max(1, BLOCK_CELLS // max(1, len(self.queries) if among is None else len(among)))
        for at in range(0, len(vectors), step):
            self._offer_block(vectors[at : at + step], rows.slice(at, step), among, None if seen is None else seen[:, at : at + step])

    def _scores(self, kind: type, vectors: np.ndarray, lengths: np.ndarray, norm: float, among: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and by how much each query's may be off."""
        if kind not in self.sides:
            self.sides[kind] = self.sides[np.float64].astype(kind)
        scores = self.sides[kind][among] @ np.concatenate((vectors, -0.5 * lengths[:, None]), axis=1).astype(kind).T
        return scores, (vectors.shape[1] + 10) * float(np.finfo(kind).eps) * norm * self.norms[among] + 0.1**COMPARE_DIGITS

    def _offer_block(self, vectors: np.ndarray, rows: pa.Table, among: np.ndarray | None, seen: np.ndarray | None) -> None:
        asking = slice(None) if among is None else among
        lengths, own = np.einsum("ij,ij->i", vectors, vectors), self.lengths[asking]
        squares = lengths + lengths * lengths / 4
        real = np.isfinite(squares)
        norm = float(np.sqrt(np.max(squares[real], initial=0.0)))
        single = real.all() and norm < 1e15 and np.max(self.norms, initial=0.0) < 1e15
        for kind in (np.float32, np.float64) if single else (np.float64,):
            scores, off = self._scores(kind, vectors, lengths, norm, asking)
            if not single:
                real = np.isfinite(scores)
                seen = real if seen is None else seen & real
            if seen is not None:
                scores[~seen] = -np.inf
            limit = self.limit[asking].copy()
            fresh = np.flatnonzero(np.isinf(limit))
            if len(fresh) and len(vectors) >= self.k:
                kth = np.partition(scores[fresh], len(vectors) - self.k, axis=1)[:, len(vectors) - self.k].astype(np.float64)
                limit[fresh] = own[fresh] - 2 * (kth - off[fresh])
            least = np.nextafter(((own - limit) / 2 - off).astype(kind), kind(-np.inf))
            near = scores >= least[:, None]
            if seen is not None:
                near &= seen
            if np.count_nonzero(near) * 16 <= near.size:
                break  # else single floats may tell too little
        query, at = np.divmod(np.flatnonzero(near), len(vectors))
        self.limit[asking] = limit
        if not len(at):
            return
        distance = np.empty(len(at))
        step = max(1, BLOCK_CELLS // max(1, vectors.shape[1]))
        query = query if among is None else among[query]
        for i in range(0, len(at), step):
            q, r = query[i : i + step], at[i : i + step]
            distance[i : i + step] = lengths[r] + self.lengths[q] - 2.0 * np.einsum("ij,ij->i", vectors[r], self.queries[q])
        distance = np.round(np.maximum(distance, 0.0), COMPARE_DIGITS)
        near = np.flatnonzero(distance <= self.limit[query])
        if len(near):
            self.pending.append((query[near], distance[near], rows.take(pa.array(at[near]))))
            self.waiting += len(near)
            if self.waiting > max(BLOCK_ROWS, self.k * len(self.queries)):
                self.merge()

    def merge(self) -> None:
        """Take in what waits."""
        if not self.pending:
            return
        table = pa.concat_tables([*([] if self.rows is None else [self.rows]), *[rows for _, _, rows in self.pending]])
        query = np.concatenate([self.query, *[q for q, _, _ in self.pending]])
        distance = np.concatenate([self.distance, *[d for _, d, _ in self.pending]])
        self.pending, self.waiting = [], 0
        ties = [pc.rank(table.column(c), tiebreaker="dense").to_numpy() for c in reversed(self.ties)]
        order = np.lexsort((*ties, distance, query))
        starts = np.searchsorted(query[order], np.arange(len(self.queries)))
        place = np.arange(len(order)) - starts[query[order]]
        kept = order[place < self.k]
        self.query, self.distance, self.rows = query[kept], distance[kept], table.take(pa.array(kept)).combine_chunks()
        last = order[place == self.k - 1]
        self.limit[query[last]] = distance[last]


def _vectors(column) -> np.ndarray:
    """Lists of equal length to a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1 if len(column) else 0)


def _embedded(batch: pa.RecordBatch) -> pa.Table:
    """Rows that have a vector. Dropped here and not by a filter, which would run an embedding UDF twice."""
    table = pa.Table.from_batches([batch])
    vectors = table.column("embedding")
    return table.filter(pc.is_valid(vectors)) if vectors.null_count else table


def _emit(best: _Best, qids: pa.Array, shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    best.merge()
    if best.rows is None:
        return
    table = best.rows.append_column("qid", qids.take(pa.array(best.query)))
    table = table.append_column("distance", pa.array(best.distance))
    yield from table.select(shape.names).cast(shape).to_batches()


def _hit_schema(queries: DataFrame, rows: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([queries.schema["qid"], T.StructField("distance", T.DoubleType()), *[rows.schema[c] for c in names]])


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _parts(table: pa.Table, column: str | None) -> Iterator[tuple[object, pa.Table]]:
    """The rows of a table by the value of a column; all of them under ``None`` without one."""
    if column is None:
        yield None, table
        return
    for value in pc.unique(table.column(column)).to_pylist():
        yield value, table.filter(pc.equal(table.column(column), value))


class _Asked:
    """A block of queries, and which of them look into each value of the probed column."""

    def __init__(self, table: pa.Table, probe: str | None):
        self.matrix, self.qids = _vectors(table.column("embedding")), table.column("qid").combine_chunks()
        self.looks: dict[object, np.ndarray] | None = None
        if probe is not None:
            lists = table.column(probe).combine_chunks()
            number = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            who = np.repeat(np.arange(len(number)), number)[order]
            cuts = np.searchsorted(codes[order], np.arange(1, len(coded.dictionary)))
            self.looks = dict(zip(coded.dictionary.to_pylist(), np.split(who, cuts), strict=True)) if len(codes) else {}


class _Run:
    """The k best of a block of queries, within each group if there are groups."""

    def __init__(self, asked: _Asked, k: int, group: str | None, probe: str | None, key: list[str]):
        self.asked, self.k, self.group, self.probe, self.key = asked, k, group, probe, key
        self.best: dict[object, _Best] = {}

    def offer(self, table: pa.Table) -> None:
        if not len(self.asked.matrix):
            return
        for value, part in _parts(table, self.group):
            if part.num_rows:
                if value not in self.best:
                    self.best[value] = _Best(self.asked.matrix, self.k, self.key)
                self._offer(self.best[value], part)

    def _offer(self, best: _Best, part: pa.Table) -> None:
        if self.probe is None:
            best.offer(_vectors(part.column("embedding")), part.select(self.key))
            return
        looks, values = self.asked.looks, pc.unique(part.column(self.probe)).to_pylist()
        values = [v for v in values if v in looks]
        if not values:
            return
        if part.num_rows >= DENSE * len(values):
            for value in values:
                some = part.filter(pc.equal(part.column(self.probe), value))
                best.offer(_vectors(some.column("embedding")), some.select(self.key), looks[value])
            return
        # Few rows of each of many values: one product, of which a query sees the rows of its values.
        place = pc.index_in(part.column(self.probe), pa.array(values, part.schema.field(self.probe).type))
        some, place = part.filter(pc.is_valid(place)), pc.drop_null(place).to_numpy()
        open_to = np.zeros((len(self.asked.matrix), len(values)), bool)
        for i, value in enumerate(values):
            open_to[looks[value], i] = True
        rows = max(1, BLOCK_CELLS // len(open_to))
        for i in range(0, some.num_rows, rows):
            few = some.slice(i, rows)
            best.offer(_vectors(few.column("embedding")), few.select(self.key), seen=open_to[:, place[i : i + rows]])

    def hits(self, shape: pa.Schema) -> Iterator[pa.RecordBatch]:
        for best in self.best.values():
            yield from _emit(best, self.asked.qids, shape)


def _nearest_broadcast(
    held: pa.Table, queries: DataFrame, rows: DataFrame, k: int, group: str | None, probe: str | None, key: list[str]
) -> DataFrame:
    schema = _hit_schema(queries, rows, key)
    shape = _arrow_schema(schema)
    shared = rows.sparkSession.sparkContext.broadcast(_Asked(held, probe))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(shared.value, k, group, probe, key)
        for batch in batches:
            run.offer(_embedded(batch))
        yield from run.hits(shape)

    return rows.mapInArrow(search, schema)


def _read(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def _packed(df: DataFrame, rows: int, probe: str | None, values: T.DataType | None) -> DataFrame:
    """Blocks of up to ``rows`` rows with a vector as Arrow streams: ``block``, a number for it, and the values it looks into or holds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> pa.RecordBatch:
            table = pa.concat_tables(held).combine_chunks()
            held.clear()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            made = {"block": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
            if probe is not None:
                column = table.column(probe).combine_chunks()
                flat = column.flatten() if pa.types.is_list(column.type) else column
                made["sees"] = pa.array([pc.drop_null(pc.unique(flat)).to_pylist()], pa.list_(flat.type))
            return pa.RecordBatch.from_pydict(made)

        for batch in batches:
            table = _embedded(batch)
            if not table.num_rows:
                continue
            most = max(1, min(rows, BLOCK_BYTES * table.num_rows // max(1, table.nbytes)))
            at = 0
            while at < table.num_rows:
                part = table.slice(at, max(1, most - sum(t.num_rows for t in held)))
                held.append(part)
                at += part.num_rows
                if sum(t.num_rows for t in held) >= most:
                    yield out()
        if held:
            yield out()

    fields = [T.StructField("block", T.BinaryType())]
    if probe is not None:
        fields.append(T.StructField("sees", T.ArrayType(values)))
    return df.mapInArrow(pack, T.StructType(fields))


def _nearest_blocked(
    queries: DataFrame, rows: DataFrame, k: int, group: str | None, probe: str | None, key: list[str], block: int
) -> DataFrame:
    """The same of any number of queries. A task has some blocks of queries, one after the other, and some blocks of rows for each."""
    spark = apply_defaults(rows.sparkSession)
    schema = _hit_schema(queries, rows, key)
    shape = _arrow_schema(schema)
    cores = spark.sparkContext.defaultParallelism
    if probe is not None:  # near each other, so that few blocks of rows concern a block of queries
        queries = queries.repartitionByRange(cores, F.col(probe)[0], "qid").sortWithinPartitions(F.col(probe)[0])
        rows = rows.where(F.col(probe).isNotNull()).repartitionByRange(cores, probe, *key).sortWithinPartitions(probe)
    else:
        queries = queries.repartition(cores)
    values = rows.schema[probe].dataType if probe is not None else None
    asked = materialize(_packed(queries, block, probe, values).withColumn("number", F.monotonically_increasing_id()))
    filed = materialize(_packed(rows, BLOCK_ROWS, probe, values))
    asked = asked.select("number", F.col("block").alias("asked"), *([F.col("sees").alias("looks")] if probe is not None else []))
    meets = F.arrays_overlap("looks", "sees") if probe is not None else F.lit(True)
    pairs = asked.join(filed.hint("shuffle_replicate_nl"), meets, "inner").select("number", "asked", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, run = None, None
        for batch in batches:
            for i, number in enumerate(batch.column("number").to_pylist()):
                if number != at:
                    if run is not None:
                        yield from run.hits(shape)
                    at, run = number, _Run(_Asked(_read(batch.column("asked")[i]), probe), k, group, probe, key)
                run.offer(_read(batch.column("block")[i]))
        if run is not None:
            yield from run.hits(shape)

    return pairs.mapInArrow(search, schema)


def nearest(
    queries: DataFrame,
    rows: DataFrame,
    k: int,
    group: str | None = None,
    probe: str | None = None,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
    key: Sequence[str] = ("id",),
    n_groups: int = 1,
) -> DataFrame:
    """The ``k`` nearest rows of every query by squared Euclidean distance, ties by id.

    ``queries`` has ``qid, embedding``; ``rows`` has ``id, embedding`` and the columns to carry along. With ``group``,
    the k nearest within each of its values, of which there are about ``n_groups``. With ``probe``, a column of the
    rows of which ``queries`` has an array, a query sees only the rows of its values. Adds ``qid, distance, rank``.

    ``key`` (and ``group``) names a row: only it, the distance and the query move. The carried columns are joined to
    the ranked hits by it, so a row's text is read for hits alone.

    A task holds k hits per query and group, so queries come in blocks of a bounded number and size: one is sent to all
    tasks, several meet the packed rows block by block, within one job.
    """
    queries = queries.select("qid", "embedding", *([probe] if probe else []))
    rows = rows.where(F.col(group).isNotNull()) if group else rows
    names = list(dict.fromkeys([*key, *([group] if group else [])]))
    lean = rows.select(*dict.fromkeys([*names, "embedding", *([probe] if probe else [])]))
    block = max(1, min(max_broadcast, MAX_HELD_HITS // (k * n_groups)))
    held = queries.limit(block + 1).toArrow()
    if held.nbytes > MAX_BROADCAST_BYTES:
        block = max(1, min(block, held.num_rows * MAX_BROADCAST_BYTES // held.nbytes))
    order = Window.partitionBy("qid", *([group] if group else [])).orderBy("distance", "id", *[n for n in names if n != "id"])
    if held.num_rows <= block:
        held = held.filter(pc.is_valid(held.column("embedding")))
        hits = _nearest_broadcast(held, queries, lean, k, group, probe, names)
    else:
        hits = _nearest_blocked(queries, lean, k, group, probe, names, block)
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if held.num_rows > block:
        best = materialize(best)
    carried = [c for c in rows.columns if c not in ("embedding", probe, *names)]
    if not carried:
        return best
    return best.join(rows.select(*names, *carried), names)
