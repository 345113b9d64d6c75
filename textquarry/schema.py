"""The fixed schemas every operator reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("doc_title", T.StringType()),
        T.StructField("doc_author", T.StringType()),
        T.StructField("doc_created", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("row_hash", T.StringType()),
        T.StructField("n_chunks", T.IntegerType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

OUTCOME = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("skip_reason", T.StringType()),
        T.StructField("n_chunks", T.IntegerType()),
    ]
)

COLLECTION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

# Values a hit falls back to when a chunk does not carry the field.
HIT_DEFAULTS = {
    "source": "",
    "source_type": "file",
    "chunk": 0,
    "doc_title": "",
    "doc_author": "",
    "doc_created": "",
}


def conform(df: DataFrame, schema: T.StructType = CHUNK) -> DataFrame:
    """Project ``df`` onto ``schema``: cast what is there, null what is not."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def hit_field(name: str, have: set[str]) -> Column:
    """A hit column with its default filled in."""
    default = HIT_DEFAULTS[name]
    if name not in have:
        return F.lit(default).alias(name)
    return F.coalesce(F.col(name), F.lit(default)).alias(name)
