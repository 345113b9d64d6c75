"""Approximate nearest neighbours by random hyperplanes.

The sides of a few hyperplanes on which a vector lies are its bucket. A query looks only into its own bucket and those
that differ in at most ``radius`` sides; distances inside are exact. Rows stored by bucket (a partition column of the
store) are pruned to the probed buckets before they are read. Rows are never shuffled by bucket, so a bucket that
holds a large part of them is searched by all tasks alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators.nearest import nearest
from textquarry.session import materialize

BITS = 4
# Of 64 random dimensions, 11 of 16 buckets hold about 87 % of the five nearest; one side less holds 61 %.
RADIUS = 2


def plane(number: int, dims: int) -> np.ndarray:
    """Normal of a hyperplane: a fair sign per dimension, from the MD5 of ``number:dimension``."""
    digits = [hashlib.md5(f"{number}:{i}".encode(), usedforsecurity=False).hexdigest()[0] for i in range(dims)]
    return np.array([1.0 if d < "8" else -1.0 for d in digits])


def bucket_of(embedding: Column, bits: int = BITS) -> Column:
    """Bucket number of a vector, one bit per hyperplane; null where there is no vector."""

    @F.pandas_udf(T.IntegerType())
    def sides(vectors: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=vectors.index, dtype="Int32")
        present = vectors.dropna()
        if len(present):
            matrix = np.stack(present.to_list()).astype(np.float64)
            planes = np.stack([plane(j, matrix.shape[1]) for j in range(bits)])
            out[present.index] = ((matrix @ planes.T >= 0) @ (1 << np.arange(bits))).astype(np.int32)
        return out

    return sides(embedding)


def with_bucket(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """Add ``bucket``; write the result partitioned by it to let searches read the probed buckets alone."""
    return rows.withColumn("bucket", bucket_of(F.col("embedding"), bits))


def probes(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Bit patterns that turn a bucket into every bucket within ``radius`` sides of it."""
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]


def nearest_probed(
    queries: DataFrame, rows: DataFrame, k: int, bits: int = BITS, radius: int = RADIUS, key: Sequence[str] = ("id",)
) -> DataFrame:
    """The ``k`` nearest rows among the probed buckets of every query: ``qid``, the ``key`` of the row, ``distance, rank``.

    ``rows`` may come with its ``bucket``: then only the buckets that some query probes, at most ``2 ** bits``, are
    read. A query whose buckets hold fewer than ``k`` rows is searched exactly; if there is none, nothing is read again.
    """
    stored = "bucket" in rows.columns
    keys = [k for k in ("id", *key) if k in rows.columns]
    keys = list(dict.fromkeys(keys))
    rows = (rows if stored else with_bucket(rows, bits)).select(*keys, "embedding", "bucket")
    patterns = F.array(*[F.lit(p) for p in probes(bits, radius)])
    probing = with_bucket(queries.select("qid", "embedding"), bits).select(
        "qid", "embedding", F.transform(patterns, lambda p: F.col("bucket").bitwiseXOR(p)).alias("bucket")
    )
    probed = rows
    if stored:
        probed = rows.where(F.col("bucket").isin([r[0] for r in probing.select(F.explode("bucket")).distinct().collect()]))
    shown = ["qid", *keys, "distance", "rank"]
    # Written once: which queries came short and their hits are both read from it.
    found = materialize(nearest(probing, probed, k, probe="bucket", key=keys).select(*shown))
    full = found.where(F.col("rank") == k).select("qid")
    short = materialize(queries.select("qid", "embedding").join(full, "qid", "left_anti"))
    if not short.limit(1).count():
        return found
    exact = nearest(short, rows.select(*keys, "embedding"), k, key=keys).select(*shown)
    return found.join(full, "qid", "left_semi").unionByName(exact)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """``qid, found, wanted`` of every query: how many of the exact hits the approximate list holds."""
    got = approximate.select("qid", "id", F.lit(1).alias("got"))
    joined = exact.select("qid", "id").join(got, ["qid", "id"], "left")
    return joined.groupBy("qid").agg(F.count("got").alias("found"), F.count(F.lit(1)).alias("wanted"))
