"""Approximate nearest neighbours by an inverted file: rows filed under the nearest of a set of trained centroids.

``train`` learns the centroids by k-means, and how far to look, from a bounded sample: of the row with the least hashes of their ids,
``max_sample`` (20,000). Every row is then filed. The number of cells is the square root of the number of rows, at most one per
``SAMPLE_PER_CELL`` sampled rows and 1,024. A query probes a cell if the cell's centroid is no more than ``margin`` times as far as the
nearest one; the margin is the least with which the wanted share of the sample's own exact neighbours would have been found, a row not
counting as its own neighbour. A sample is thinner than the table, so its neighbours lie further off: the margin errs to more cells.
Beyond the margin, a query goes on to further cells until those it probes hold ``k`` rows, so none comes short and nothing is searched
a second time.

Rows do not move to be searched, so a cell with a large part of them is searched by all tasks alike. ``write_cells`` stores rows by
cell, the large ones split over files; of rows so stored the cells that no query probes are not read.

Rows without an id are no hits; rows without a vector have no cell; copies of a row are rows of their own. Queries without a vector
find nothing. Without any row there is one cell and no hit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators import nearest as exact
from textquarry.session import materialize

MAX_SAMPLE = 20_000
SAMPLE_PER_CELL = 16
MAX_CELLS = 1024
ROUNDS = 20
SLACK = 0.03  # share of neighbours aimed at above the wanted one, for what a sample cannot tell
MAX_HELD = 1_000_000  # probed cells that one block of queries may name


@dataclass(frozen=True, eq=False)
class InvertedFile:
    """Centroids (one row per cell) and the margin within which cells are probed."""

    centroids: np.ndarray
    margin: float

    def far(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distance of every vector to every centroid."""
        return _squares(vectors, self.centroids)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(x) for x in c], float(self.margin)) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>, margin double").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> InvertedFile:
        rows = spark.read.parquet(path).orderBy("cell").limit(MAX_CELLS).collect()
        return InvertedFile(np.array([r.centroid for r in rows]), rows[0].margin)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T), 0.0)


def _k_means(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds from the first distinct vectors; a cell that runs empty starts anew at the vector worst served."""
    _, first = np.unique(sample, axis=0, return_index=True)
    centroids = sample[np.sort(first)[:cells]].copy()
    for _ in range(ROUNDS):
        far = _squares(sample, centroids)
        own = far.argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        sizes = np.bincount(own, minlength=len(centroids))
        moved = sums / np.maximum(sizes, 1)[:, None]
        empty = np.flatnonzero(sizes == 0)
        moved[empty] = sample[np.argsort(-far.min(1), kind="stable")[: len(empty)]]
        if np.allclose(moved, centroids, rtol=0, atol=1e-9):
            break
        centroids = moved
    return centroids


def _margin(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> float:
    """The least ratio of distances to centroids that reaches ``recall`` over up to 1,000 rows of the sample and their neighbours."""
    if len(sample) < 2:
        return 1.0
    far = _squares(sample, centroids)
    own, asked = far.argmin(1), np.arange(0, len(sample), max(1, len(sample) // 1000))
    ratios = []
    for at in range(0, len(asked), 100):
        some = asked[at : at + 100]
        cells = _squares(sample[some], sample)
        cells[np.arange(len(some)), some] = np.inf
        near = np.argpartition(cells, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
        least = np.sqrt(far[some].min(1))[:, None]
        ratios.append(np.sqrt(far[some[:, None], own[near]]) / np.maximum(least, 1e-12))
    return max(1.0, float(np.quantile(np.concatenate(ratios), min(1.0, recall + SLACK), method="higher")))


def train(rows: DataFrame, k: int = 5, recall: float = 0.9, cells: int | None = None, max_sample: int = MAX_SAMPLE) -> InvertedFile:
    """Learn cells and margin for ``rows`` (``id, embedding``)."""
    if not 0 < recall <= 1:
        raise ValueError(f"recall has to be above 0 and at most 1, not {recall}")
    held = rows.where(F.col("embedding").isNotNull()).select("id", "embedding")
    sample = held.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("embedding").toArrow()
    if not sample.num_rows:
        return InvertedFile(np.zeros((1, 1)), 1.0)
    n = sample.num_rows if sample.num_rows < max_sample else held.count()
    vectors = exact._vectors(sample.column("embedding"))
    wanted = round(math.sqrt(n)) if cells is None else cells
    centroids = _k_means(vectors, max(1, min(wanted, len(vectors) // SAMPLE_PER_CELL, MAX_CELLS)))
    return InvertedFile(centroids, _margin(vectors, centroids, k, recall))


def cell_of(embedding: Column, index: InvertedFile) -> Column:
    """The cell of a vector, the first of equally near ones; null where there is none."""

    @F.pandas_udf(T.IntegerType())
    def nearest_cell(vectors: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=vectors.index, dtype="Int32")
        present = vectors.dropna()
        if len(present):
            out[present.index] = index.far(np.stack(present.to_list()).astype(np.float64)).argmin(1).astype(np.int32)
        return out

    return nearest_cell(embedding)


def with_cell(rows: DataFrame, index: InvertedFile) -> DataFrame:
    return rows.withColumn("cell", cell_of(F.col("embedding"), index))


def write_cells(rows: DataFrame, index: InvertedFile, path: str) -> DataFrame:
    """Store rows in a folder per cell and read them back. Ranges of cell and id are dealt out, so a large cell has several files."""
    with_cell(rows, index).where("cell IS NOT NULL").repartitionByRange("cell", "id").write.partitionBy("cell").parquet(path)
    return rows.sparkSession.read.parquet(path)


def probed_cells(queries: DataFrame, index: InvertedFile, sizes: dict[int, int], k: int) -> DataFrame:
    """``qid, embedding, cells`` of every query with a vector. ``sizes``: rows of every cell that has any."""
    held = np.array(sorted(sizes), dtype=np.int64)
    counts = np.array([sizes[c] for c in held.tolist()], dtype=np.int64)
    schema = T.StructType([queries.schema["qid"], queries.schema["embedding"], T.StructField("cells", T.ArrayType(T.IntegerType()))])
    shape = exact._arrow_schema(schema)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = exact._embedded(batch)
            if not table.num_rows or not len(held):
                continue
            far = np.sqrt(index.far(exact._vectors(table.column("embedding")))[:, held])
            order = np.argsort(far, axis=1, kind="stable")
            ranked = np.take_along_axis(far, order, axis=1)
            before = np.cumsum(counts[order], axis=1) - counts[order]
            take = (ranked <= index.margin * ranked[:, :1]) | (before < k)
            cells = [held[o[t]].tolist() for o, t in zip(order, take, strict=True)]
            yield from table.append_column("cells", pa.array(cells, pa.list_(pa.int32()))).cast(shape).to_batches()

    return queries.select("qid", "embedding").mapInArrow(choose, schema)


def nearest_filed(queries: DataFrame, rows: DataFrame, index: InvertedFile, k: int, key: Sequence[str] = ("id",)) -> DataFrame:
    """The ``k`` nearest rows among the probed cells of every query: ``qid``, the ``key`` of the row, ``distance, rank``.

    ``rows`` may come with their ``cell``. A task holds k hits per query, however many cells the query probes. Queries go
    out in blocks bounded by their number and by the cells that they name (see ``operators.nearest``).
    """
    keys = list(dict.fromkeys(["id", *key]))
    filed = (rows if "cell" in rows.columns else materialize(with_cell(rows.select(*keys, "embedding"), index))).select(*keys, "embedding", "cell")
    filed = filed.where(F.col("id").isNotNull())
    sizes = {r.cell: r["n"] for r in filed.where("cell IS NOT NULL").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    probing = materialize(probed_cells(queries, index, sizes, k))
    many = probing.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cells")).alias("probes")).first()
    block = max(1, min(exact.MAX_BROADCAST_QUERIES, MAX_HELD * many["n"] // max(1, many["probes"] or 0)))
    probed = {r[0] for r in probing.select(F.explode("cells")).distinct().collect()}
    if probed < sizes.keys():
        filed = filed.where(F.col("cell").isin(sorted(probed)))
    found = exact.nearest(probing.withColumnRenamed("cells", "cell"), filed, k, probe="cell", max_broadcast=block, key=keys)
    return found.select("qid", *keys, "distance", "rank")
