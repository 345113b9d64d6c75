"""The registered queries of this subpackage: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import table
from textquarry.llm.decontaminate import find_contamination
from textquarry.llm.html_density import extract_main_text
from textquarry.llm.license_templates import report as license_report
from textquarry.llm.link_trust import judge_urls
from textquarry.llm.merkle_manifest import audit
from textquarry.llm.mixing import DOMAINS, copies, mixing_rates
from textquarry.llm.quality import judge
from textquarry.llm.secrets import report
from textquarry.llm.sharding import assign_shards
from textquarry.llm.simhash import near_duplicates
from textquarry.llm.suffix_trees import remove_repeats
from textquarry.llm.token_alignment import align
from textquarry.llm.token_files import read_token_files, write_token_files
from textquarry.session import apply_defaults, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.array_join(spans, ",").alias("spans"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(apply_defaults(spark), "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    doc_id = F.col("carried.doc_id")
    posteriors = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return fit.rated.select(doc_id.alias("doc_id"), "n_tokens", *posteriors, "rate", copies(F.col("rate"), doc_id, F.col("n_tokens")).alias("copies"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


@query
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


@query
def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align(table(spark, sf_dir, "documents"), *paths)
