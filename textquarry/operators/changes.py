"""What is new, what changed and what has to go: set-based change detection and replacement.

The large side of these joins is a chunk table, the other a list of keys. The list is written once as Parquet, so Spark
knows its size: it broadcasts a small one, and the chunks are not shuffled. Beyond its own threshold both sides are
shuffled, and adaptive execution splits a partition that is too large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.identity import existence_key
from textquarry.session import materialize

NEW, CHANGED, UNCHANGED = "new", "changed", "unchanged"


def stored_hashes(chunks: DataFrame, keys: list[str], hash_column: str) -> DataFrame:
    """One stored hash per key, from its first chunk. The filter on ``chunk`` reaches the scan, so that the other
    chunks of a source are not read."""
    first = chunks.where("chunk = 0").select(*keys, hash_column)
    return first.groupBy(*keys).agg(F.min(hash_column).alias("stored_hash"))


def classify(incoming: DataFrame, stored: DataFrame, keys: list[str], hash_column: str) -> DataFrame:
    """Add ``change``: ``new`` where the key is not stored, else ``unchanged`` or ``changed`` by hash."""
    known = stored.select(*keys, F.col("stored_hash"), F.lit(True).alias("_known"))
    change = (
        F.when(F.col("_known").isNull(), NEW)
        .when(F.col("stored_hash").eqNullSafe(F.col(hash_column)), UNCHANGED)
        .otherwise(CHANGED)
    )
    return incoming.join(known, keys, "left").withColumn("change", change).drop("_known", "stored_hash")


def pick(content: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Content rows of the given keys, with the columns of ``keys``."""
    return content.join(materialize(keys), on)


def without(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Stored chunks whose key is not in ``gone``."""
    return stored.join(materialize(gone.select(*keys).distinct()), keys, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str] = ["collection", "id"]) -> DataFrame:
    """Insert or replace by id. The incoming chunks are written once, as both their ids and their rows are needed."""
    incoming = materialize(incoming)
    return without(stored, incoming, keys).unionByName(incoming, allowMissingColumns=True)


def replace_sources(stored: DataFrame, incoming: DataFrame, replaced: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every old chunk of a replaced source, the ones beyond its new length included, then add the new ones."""
    return without(stored, replaced, keys).unionByName(incoming, allowMissingColumns=True)


def extra_ids(stored: DataFrame, predicted: DataFrame) -> DataFrame:
    """Stored ids that are not among the predicted ones: what an unfinished run left behind."""
    return stored.select("id").join(predicted.select("id"), "id", "left_anti")


def predicted_ids(rows: DataFrame, id_of) -> DataFrame:
    """Ids that a row with ``n_chunks`` chunks has; ``id_of(source, row_id, chunk)`` gives one."""
    numbered = rows.withColumn("chunk", F.explode(F.expr("sequence(0, n_chunks - 1)")))
    return numbered.select(id_of(F.col("source"), F.col("row_id"), F.col("chunk")).alias("id"))


def _stale(sources: DataFrame, live: DataFrame) -> DataFrame:
    """Add ``_stale``: a source is named, and what must exist for it is not in ``live``."""
    present = live.select(F.col("source").alias("_key")).distinct().withColumn("_live", F.lit(True))
    keyed = sources.withColumn("_key", existence_key(F.coalesce(F.col("source"), F.lit(""))))
    gone = F.col("_live").isNull() & (F.col("_key") != "")
    return keyed.join(present, "_key", "left").withColumn("_stale", gone).drop("_key", "_live")


def stale_sources(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """Sources that no longer exist, each looked up once."""
    return _stale(chunks.select("source").distinct(), live).where("_stale").select("source")


def purge(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """Chunks whose source still exists. Row sources are looked up by the part before ``::``; a chunk without a
    source is kept."""
    return without(chunks, stale_sources(chunks, live), ["source"])


def purge_counts(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """``chunks_checked, chunks_deleted`` of a purge. Chunks are counted per source before the join."""
    per_source = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return _stale(per_source, live).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks_checked"),
        F.coalesce(F.sum(F.when(F.col("_stale"), F.col("n"))), F.lit(0)).alias("chunks_deleted"),
    )
