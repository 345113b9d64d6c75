"""Ingest of files and of table rows: detect changes, extract, chunk, identify."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.chunking import ChunkOptions, chunk_text
from textquarry.functions.embedding import embed
from textquarry.functions.identity import basename, chunk_id, content_hash, row_chunk_id, row_hash
from textquarry.functions.text import row_text, template_text
from textquarry.operators.changes import UNCHANGED, classify, pick, replace_sources, stored_hashes
from textquarry.schema import CHUNK, OUTCOME, conform
from textquarry.session import materialize
from textquarry.sources.files import extract_files, scan_files, scan_paths
from textquarry.sources.tables import ROW_ID, scan_table

FILE, ROW = "file", "sqlite"


@dataclass(frozen=True)
class IngestOptions:
    """``materialize`` writes the chunked sources to the shared folder, so that chunks and outcomes are read from
    one pass over the files; leave it off where only one of the two is used."""

    chunking: ChunkOptions = field(default_factory=ChunkOptions)
    incremental: bool = False
    embedding_model: str | None = None
    materialize: bool = False


@dataclass(frozen=True)
class Ingest:
    """What a run yields: new chunks, one outcome per source, and the keys whose old chunks they replace."""

    chunks: DataFrame
    outcomes: DataFrame
    replaced: DataFrame
    keys: list[str]

    def apply(self, stored: DataFrame | None) -> DataFrame:
        """The collection after the run."""
        if stored is None:
            return self.chunks
        return replace_sources(stored, self.chunks, self.replaced, self.keys)


def explode_chunks(sources: DataFrame, chunks: str = "chunks") -> DataFrame:
    """One row per chunk, numbered from 0 within its source, the other columns repeated.

    The outer form, because the optimizer would push the other one's "not empty" test below the chunking UDF, which
    then runs twice.
    """
    keep = [c for c in sources.columns if c != chunks]
    return sources.select(*keep, F.posexplode_outer(chunks).alias("chunk", "text")).where("chunk is not null")


def _finish(chunks: DataFrame, model: str | None) -> DataFrame:
    if model is not None:
        chunks = chunks.withColumn("embedding", embed(F.col("text"), model))
    return conform(chunks, CHUNK)


def _split_by_change(
    content: DataFrame, hashed: DataFrame, known: DataFrame | None, key: str, hash_column: str
) -> tuple[DataFrame, DataFrame | None]:
    """The content to work on, with its hash, and the keys left out as unchanged.

    Only keys and hashes take part in the comparison. Its result is written once; the content of changed keys is then
    picked by key, so the content of an unchanged source is never shuffled.
    """
    if known is None:
        return content, None
    judged = materialize(classify(hashed, known, [key], hash_column))
    changed = judged.where(F.col("change") != UNCHANGED).select(key, hash_column)
    return pick(content.drop(hash_column), changed, key), judged.where(F.col("change") == UNCHANGED).select(key)


def _report(done: DataFrame, unchanged: DataFrame | None, key: str) -> DataFrame:
    """``key, status, skip_reason, n_chunks`` of the worked and of the unchanged sources."""
    if unchanged is None:
        return done
    same = unchanged.select(
        key,
        F.lit("skipped").alias("status"),
        F.lit("hash_match").alias("skip_reason"),
        F.lit(0).alias("n_chunks"),
    )
    return done.unionByName(same)


def _outcomes(report: DataFrame, name: Column, *order: Column) -> DataFrame:
    """Outcomes in order of their source: after the sort, the generated numbers increase along it."""
    ordered = report.orderBy(*order).withColumns({"seq": F.monotonically_increasing_id(), "name": name})
    return conform(ordered, OUTCOME)


def known_files(stored: DataFrame, collection: str) -> DataFrame:
    """``source, stored_hash`` of the files in a collection."""
    own = stored.where((F.col("collection") == collection) & (F.col("source_type") == FILE))
    return stored_hashes(own, ["source"], "file_hash")


def known_rows(stored: DataFrame, collection: str, source: str) -> DataFrame:
    """``row_id, stored_hash`` of the rows of one table in a collection."""
    own = stored.where((F.col("collection") == collection) & (F.col("source") == source))
    return stored_hashes(own, ["row_id"], "row_hash")


def ingest_files(
    files: DataFrame,
    collection: str,
    known: DataFrame | None = None,
    options: IngestOptions = IngestOptions(),
    id_of=chunk_id,
) -> Ingest:
    """Ingest ``path, content`` rows into a collection.

    ``known`` (``source, stored_hash``) is what an incremental run compares with, before any text is extracted; the
    hash is stored on every run. A ``skip_reason`` column, as ``scan_paths`` gives it, is passed on.
    """
    given = F.col("skip_reason") if "skip_reason" in files.columns else F.lit(None).cast("string")
    files = files.select(F.col("path").alias("source"), "content", given.alias("given"))
    opened = files.where("given is null").drop("given").withColumn("file_hash", content_hash(F.col("content")))
    work, unchanged = _split_by_change(
        opened, opened.drop("content"), known if options.incremental else None, "source", "file_hash"
    )

    extracted = extract_files(work.withColumnRenamed("source", "path")).withColumnRenamed("path", "source")
    chunked = extracted.withColumn(
        "chunks", chunk_text(F.when(F.col("error").isNull(), F.col("text")), options.chunking)
    ).drop("text")
    if options.materialize:
        chunked = materialize(chunked)

    new = explode_chunks(chunked.drop("error")).withColumns(
        {
            "collection": F.lit(collection),
            "id": id_of(F.col("source"), F.col("chunk")),
            "source_type": F.lit(FILE),
        }
    )
    n, error = F.size("chunks"), F.col("error")
    done = chunked.select(
        "source",
        F.when(error.isNotNull(), "error").when(n == 0, "skipped").otherwise("ingested").alias("status"),
        F.when(error.isNotNull(), F.concat(F.lit("extract_error: "), error)).when(n == 0, "empty").alias("skip_reason"),
        n.alias("n_chunks"),
    )
    refused = files.where("given is not null").select(
        "source", F.lit("skipped").alias("status"), F.col("given").alias("skip_reason"), F.lit(0).alias("n_chunks")
    )
    report = _report(done, unchanged, "source").unionByName(refused)
    # A source that could not be read keeps its old chunks; an empty one loses them.
    replaced = chunked.where("error is null").select(
        F.lit(collection).alias("collection"), "source", F.col("file_hash").alias("hash")
    )
    return Ingest(
        _finish(new, options.embedding_model),
        _outcomes(report, basename(F.col("source")), F.col("source")),
        replaced,
        ["collection", "source"],
    )


def ingest_folder(
    spark: SparkSession,
    folder: str,
    collection: str,
    stored: DataFrame | None = None,
    options: IngestOptions = IngestOptions(),
) -> Ingest:
    """Ingest every supported file below a folder."""
    known = known_files(stored, collection) if stored is not None else None
    return ingest_files(scan_files(spark, folder), collection, known, options)


def ingest_paths(
    requested: DataFrame,
    listing: DataFrame,
    collection: str,
    stored: DataFrame | None = None,
    options: IngestOptions = IngestOptions(),
) -> Ingest:
    """Ingest a list of paths; a missing or unsupported one is a skipped outcome."""
    known = known_files(stored, collection) if stored is not None else None
    return ingest_files(scan_paths(requested, listing), collection, known, options)


def table_texts(
    table: DataFrame, columns: list[str] | None = None, id_column: str = "id", template: str | None = None
) -> DataFrame:
    """``row_id, row_text, row_hash`` of a table. The id column is left out of the default text."""
    scan = scan_table(table, columns, id_column)
    if template:
        text = template_text(scan.rows, template, scan.columns)
    else:
        text = row_text(scan.rows, [c for c in scan.columns if c != scan.id_column])
    texts = scan.rows.select(F.col(ROW_ID).alias("row_id"), text.alias("row_text"))
    if scan.id_column:
        texts = _one_per_id(texts)
    return texts.withColumn("row_hash", row_hash(F.col("row_text")))


def _one_per_id(texts: DataFrame) -> DataFrame:
    """Rows of one id are one source. A table has no order in which the last could win, so the greatest text does.

    Ids alone are counted; only rows of repeated ids move.
    """
    repeated = materialize(texts.groupBy("row_id").count().where("count > 1").select("row_id"))
    several = texts.join(repeated, "row_id", "left_semi").groupBy("row_id").agg(F.max("row_text").alias("row_text"))
    return texts.join(repeated, "row_id", "left_anti").unionByName(several)


def ingest_table(
    table: DataFrame,
    source: str,
    collection: str,
    known: DataFrame | None = None,
    columns: list[str] | None = None,
    id_column: str = "id",
    template: str | None = None,
    options: IngestOptions = IngestOptions(),
) -> Ingest:
    """Ingest the rows of a table; ``source`` is its name as ``store::table``.

    Text that is too short for a chunk of its own is kept as one. ``known`` is ``row_id, stored_hash``.
    """
    texts = table_texts(table, columns, id_column, template)
    work, unchanged = _split_by_change(
        texts, texts.drop("row_text"), known if options.incremental else None, "row_id", "row_hash"
    )
    windows = F.col("windows")
    chunked = (
        work.withColumn("windows", chunk_text(F.col("row_text"), options.chunking))
        .withColumn(
            "chunks",
            F.when((F.size(windows) == 0) & (F.col("row_text") != ""), F.array("row_text")).otherwise(windows),
        )
        .select("row_id", "row_hash", "chunks", F.size("chunks").alias("n_chunks"))
    )
    if options.materialize:
        chunked = materialize(chunked)

    new = explode_chunks(chunked).withColumns(
        {
            "collection": F.lit(collection),
            "source": F.lit(source),
            "source_type": F.lit(ROW),
            "id": row_chunk_id(F.lit(source), F.col("row_id"), F.col("chunk")),
        }
    )
    none = F.col("n_chunks") == 0
    done = chunked.select(
        "row_id",
        F.when(none, "skipped").otherwise("ingested").alias("status"),
        F.when(none, "empty_text").alias("skip_reason"),
        "n_chunks",
    )
    replaced = chunked.select(
        F.lit(collection).alias("collection"), F.lit(source).alias("source"), "row_id", F.col("row_hash").alias("hash")
    )
    row_id = F.col("row_id")
    name = F.concat(F.lit(source.split("::")[-1] + "["), row_id, F.lit("]"))
    return Ingest(
        _finish(new, options.embedding_model),
        _outcomes(_report(done, unchanged, "row_id"), name, row_id.try_cast("long"), row_id),
        replaced,
        ["collection", "source", "row_id"],
    )
