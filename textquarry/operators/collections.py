"""Collections: listing, statistics and maintenance.

A collection is the set of chunks that carry its name, plus one row in the ``collections`` table. Every operator takes
and returns DataFrames; writing them is up to the caller or to ``textquarry.sinks.store``.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.errors import CollectionExistsError, CollectionNotFoundError
from textquarry.functions.validation import check_collection_name, check_description
from textquarry.operators.changes import purge, purge_counts, without
from textquarry.schema import COLLECTION

log = logging.getLogger(__name__)


def exists(collections: DataFrame, name: str) -> bool:
    return not collections.where(F.col("name") == name).isEmpty()


def require(collections: DataFrame, name: str) -> None:
    if not exists(collections, name):
        raise CollectionNotFoundError(f"collection not found: {name!r}")


def stored_model(collections: DataFrame, name: str, requested: str) -> str:
    """The model a collection was built with wins over the requested one."""
    row = collections.where(F.col("name") == name).select("embedding_model").first()
    if row is None:
        raise CollectionNotFoundError(f"collection not found: {name!r}")
    return row["embedding_model"] or requested


def create_collection(collections: DataFrame, name: str, model: str) -> DataFrame:
    """Add the collection unless it is there; warn if it was built with another model."""
    row = collections.where(F.col("name") == name).select("embedding_model").first()
    if row is None:
        added = collections.sparkSession.createDataFrame([(name, model, "")], COLLECTION)
        return collections.unionByName(added)
    if row["embedding_model"] and row["embedding_model"] != model:
        log.warning("collection %r was built with model %r, not %r", name, row["embedding_model"], model)
    return collections


def model_mismatches(collections: DataFrame, requested: DataFrame) -> DataFrame:
    """Collections whose stored model is not the requested one, for a table of ``name, model`` requests."""
    joined = collections.join(requested, "name")
    differs = (F.coalesce("embedding_model", F.lit("")) != "") & (F.col("embedding_model") != F.col("model"))
    return joined.where(differs).select("name", "embedding_model", F.col("model").alias("requested_model"))


def list_collections(collections: DataFrame) -> DataFrame:
    return collections.select("name").distinct().orderBy("name")


def embedding_models(collections: DataFrame) -> DataFrame:
    """The distinct models in use."""
    return collections.select("embedding_model").where("embedding_model <> ''").distinct().orderBy("embedding_model")


def _of(chunks: DataFrame, collection: str | None) -> DataFrame:
    return chunks if collection is None else chunks.where(F.col("collection") == collection)


def scan_collection(chunks: DataFrame, collection: str, include: list[str] | None = None) -> DataFrame:
    """Ids of a collection and the chosen columns; only these are read."""
    return _of(chunks, collection).select("id", *(include or []))


def sources(chunks: DataFrame, collection: str | None = None) -> DataFrame:
    """Distinct non-empty sources, sorted."""
    return _of(chunks, collection).select("source").where("source <> ''").distinct().orderBy("source")


def source_counts(chunks: DataFrame, collection: str | None = None) -> DataFrame:
    """Chunks per non-empty source, sorted by source."""
    counted = _of(chunks, collection).where("source <> ''").groupBy("source")
    return counted.agg(F.count(F.lit(1)).alias("chunks")).orderBy("source")


def collection_stats(chunks: DataFrame, collections: DataFrame) -> DataFrame:
    """Chunks and distinct sources of every collection, empty ones included, with model and description.

    Chunks are counted per (collection, source) first, so a large collection is spread over its sources.
    """
    per_source = chunks.groupBy("collection", "source").agg(F.count(F.lit(1)).alias("n"))
    counted = per_source.groupBy(F.col("collection").alias("name")).agg(
        F.sum("n").alias("total_chunks"), F.count_if(F.col("source") != "").alias("total_sources")
    )
    return collections.join(counted, "name", "left").select(
        "name",
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
        F.coalesce("total_sources", F.lit(0)).alias("total_sources"),
        F.coalesce("embedding_model", F.lit("")).alias("embedding_model"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def stats_of(chunks: DataFrame, collections: DataFrame, name: str) -> DataFrame:
    """Statistics of one collection; an unknown name is an error."""
    require(collections, name)
    return collection_stats(_of(chunks, name), collections.where(F.col("name") == name))


def delete_source(chunks: DataFrame, collection: str, source: str) -> DataFrame:
    """The chunks left after all chunks of one source are dropped from a collection."""
    gone = (F.col("collection") == collection) & F.coalesce(F.col("source") == source, F.lit(False))
    return chunks.where(~gone)


def delete_sources(chunks: DataFrame, collection: str, gone: DataFrame) -> DataFrame:
    """The chunks left after many sources, given as a table, are dropped from a collection."""
    keyed = gone.select(F.lit(collection).alias("collection"), "source")
    return without(chunks, keyed, ["collection", "source"])


def deletion_counts(chunks: DataFrame, collection: str, gone: DataFrame) -> DataFrame:
    """``source, chunks_deleted`` per requested source; 0 where nothing was stored for it."""
    counted = _of(chunks, collection).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return gone.select("source").distinct().join(counted, "source", "left").select(
        "source", F.coalesce("n", F.lit(0)).alias("chunks_deleted")
    )


def purge_collection(
    chunks: DataFrame, collections: DataFrame, name: str, live: DataFrame, raise_if_missing: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The chunks left after the stale ones of a collection are dropped, and the counts of the purge."""
    if raise_if_missing:
        require(collections, name)
    others = chunks.where(~F.col("collection").eqNullSafe(name))
    return others.unionByName(purge(_of(chunks, name), live)), purge_counts(_of(chunks, name), live)


def reset(chunks: DataFrame, collections: DataFrame, name: str, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """Drop a collection with its chunks. An unknown name changes nothing."""
    if not confirm:
        raise ValueError("reset deletes a whole collection; pass confirm=True")
    return chunks.where(~F.col("collection").eqNullSafe(name)), collections.where(~F.col("name").eqNullSafe(name))


def rename(chunks: DataFrame, collections: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Give a collection another name, whatever its size."""
    check_collection_name(new)
    require(collections, old)
    if exists(collections, new):
        raise CollectionExistsError(f"collection already exists: {new!r}")

    def renamed(column: str):
        return F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column))

    return (
        chunks.withColumn("collection", renamed("collection")),
        collections.withColumn("name", renamed("name")),
    )


def describe(collections: DataFrame, name: str, text: str) -> DataFrame:
    """Set the description of a collection, the rest of its row unchanged."""
    check_description(text)
    require(collections, name)
    return collections.withColumn("description", F.when(F.col("name") == name, F.lit(text)).otherwise(F.col("description")))
