"""Inputs the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.chunking import ChunkOptions, chunk_text
from textquarry.functions.embedding import DEFAULT_MODEL
from textquarry.operators.ingest import explode_chunks, ingest_files
from textquarry.operators.search import embed_chunks, embed_queries
from textquarry.schema import COLLECTION
from textquarry.session import apply_defaults, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_defaults(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_chunks(
    spark: SparkSession, sf_dir: str, options: ChunkOptions = ChunkOptions(), columns: tuple[str, ...] = ()
) -> DataFrame:
    """Chunks of every document: ``doc_id, …columns, chunk, text``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", *columns, "text"))
    chunked = docs.select("doc_id", *columns, chunk_text(F.col("text"), options).alias("chunks"))
    return explode_chunks(chunked)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a chunk table: a collection per language, the document source as source."""
    chunks = document_chunks(spark, sf_dir, columns=("source", "lang"))
    return chunks.select(
        F.col("lang").alias("collection"),
        document_chunk_id(F.col("source"), F.col("doc_id"), F.col("chunk")).alias("id"),
        "text",
        F.lit("file").alias("source_type"),
        "source",
        "chunk",
        "doc_id",
    )


def document_chunk_id(source: Column, doc_id: Column, chunk: Column) -> Column:
    return F.md5(F.concat_ws("::", source, doc_id.cast("string"), chunk.cast("string")))


def corpus_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per language; every one built with the default model."""
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).distinct()
    return langs.select(
        "name", F.lit(DEFAULT_MODEL).alias("embedding_model"), F.concat(F.lit("texts in "), "name").alias("description")
    )


def document_path() -> Column:
    return F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text file: ``path, content``."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(document_path().alias("path"), F.col("text").cast("binary").alias("content"))


def stored_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of these files: the labelled ones only, those of quality 0 with another ending."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = spread(table(spark, sf_dir, "documents")).join(labels, "doc_id")
    old = F.when(F.col("quality") == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    return docs.select(document_path().alias("path"), old.cast("binary").alias("content"))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table of the earlier state, in the collection ``docs``."""
    return ingest_files(stored_document_files(spark, sf_dir), "docs").chunks


def stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the orders: none of the open ones, the urgent ones with another status."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'")
    return orders.withColumn(
        "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "?").otherwise(F.col("o_orderstatus"))
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts as queries: ``qid, query_text, embedding``."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query_text"))
    return embed_queries(texts)


def embedded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_chunks(corpus(spark, sf_dir))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as rows to search: the label is metadata and, with a prefix, the collection."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        "embedding",
        "label",
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("collection"),
    )
