"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm.common import stored, table
from textquarry.llm.decontaminate import drop_contaminated
from textquarry.llm.mixing import mix
from textquarry.llm.near_copies import keep_one
from textquarry.llm.quality import keep_good
from textquarry.llm.token_files import read_token_files, write_token_files
from textquarry.session import apply_defaults, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host fails them, go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity of 0.8 or more) stays: the one of the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go, those of low quality are thinned out to their weight, the others stay."""
    return mix(docs, table(spark, sf_dir, "labels"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token files in the shared folder; the rows are read back from them."""
    import public_tokenizers

    path = scratch_path(apply_defaults(spark), "corpus-tokens")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_files),
]

# Fingerprints by XXH64, suffix searches and Huffman files are not expressible in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
