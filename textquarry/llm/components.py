"""Connected components of an edge table by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import stored


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least neighbour of the node (itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _nearest(both).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node, are linked to its least neighbour. ``edges`` run from greater to lesser."""
    linked = edges.join(_nearest(edges), "u")
    down = linked.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = linked.where("v = low").select("u", "v")
    return down.unionByName(own)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` to ``(node, root)``: the least node reachable, for every node that an edge names. Self loops are allowed.

    A round is four shuffles of the edges that are left, of two longs each; rounds grow with the logarithm of the longest chain. A
    node with very many edges only loses its rows to partial aggregation and to joins that Spark can split.
    """
    directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now = stored(directed.dropDuplicates(), "edges")
    seen = None
    for _ in range(max_rounds):
        now = stored(_small_star(_large_star(now).dropDuplicates()).dropDuplicates(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).dropDuplicates()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
