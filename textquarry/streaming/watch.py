"""A watched folder: new files by stream, edits and deletions by a reconciling batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.operators.ingest import IngestOptions, ingest_files
from textquarry.sinks.store import ChunkStore
from textquarry.sources.files import is_supported, scan_files
from textquarry.streaming.throttle import every

# The file source of a stream needs its schema given.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New supported files below ``folder`` as ``path, content``."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")
    return reader.load(folder).select(path, "content").where(is_supported(F.col("path")))


def ingest_stream(
    files: DataFrame,
    store: ChunkStore,
    collection: str,
    checkpoint: str,
    options: IngestOptions = IngestOptions(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Ingest each micro-batch of ``path, content`` incrementally. A batch that is run again finds its hashes stored.

    A watch has its own collection and options. The default trigger is the change interval of three seconds.
    """
    options = IngestOptions(options.chunking, True, options.embedding_model, True)

    def ingest(batch: DataFrame, _epoch: int) -> None:
        store.append(ingest_files(batch, collection, store.known_files(collection), options))

    return (
        files.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "3 seconds"}))
        .start()
    )


def watch_folder(
    spark: SparkSession, folder: str, store: ChunkStore, collection: str, checkpoint: str, **how
) -> StreamingQuery:
    return ingest_stream(file_stream(spark, folder), store, collection, checkpoint, **how)


def reconcile(
    spark: SparkSession, folder: str, store: ChunkStore, collection: str, options: IngestOptions = IngestOptions()
) -> DataFrame:
    """Bring a collection in line with its folder: edited files are ingested again, missing ones removed.

    The file stream reports neither. Hashes are compared with the ledger; the outcomes of the ingest are returned.
    """
    options = IngestOptions(options.chunking, True, options.embedding_model, True)
    files = scan_files(spark, folder)
    run = ingest_files(files, collection, store.known_files(collection), options)
    store.append(run)
    root = folder.rstrip("/") + "/"
    below = store.known_files(collection).where(F.col("source").startswith(root)).select("source")
    gone = below.join(files.select(F.col("path").alias("source")), "source", "left_anti")
    store.remove(collection, gone)
    return run.outcomes


def follow_folder(
    spark: SparkSession, folder: str, store: ChunkStore, collection: str, checkpoint: str, interval: str = "1 minute", options: IngestOptions = IngestOptions()
) -> StreamingQuery:
    """Reconcile a collection with its folder once per interval: what is new, edited or gone."""
    return every(spark, lambda: reconcile(spark, folder, store, collection, options), checkpoint, interval)
