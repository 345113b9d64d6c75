"""Quality rules with host verdicts: rule failures by host, shrunk with an empirical beta prior, joined back to documents.

Every document is measured from its whole text with built-in functions only. A document fails when a rule of its own fails
(too few words, or more than half of its words in repeated three-word windows). Hosts are judged by how many of their documents
fail any rule, also the softer ones (symbols, repeated lines): the rate of a host is shrunk towards the rate of all hosts with a
beta prior fitted to the hosts by moments, so that a host with few documents is not rejected by chance. A host whose shrunk rate
is above ``max_host_rate`` takes all its documents with it.

Nulls: a null text has no words and fails; a null host is a host of its own. Repeated rows are judged and counted one by one. An
empty table gives an empty table. Equal words are found by a 64-bit hash of each window within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import let, stored, words

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_100_words: int = 50
    max_dup_lines_per_100_words: int = 10
    max_host_rate: float = 0.6
    # Bounds of the prior's weight in documents: hosts that all agree would give an infinite one.
    min_prior_documents: float = 2.0
    max_prior_documents: float = 1000.0


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))


def _windows(tokens: Column) -> Column:
    """``(hash, start)`` of each window of three words, in the order of the hashes."""
    last = F.size(tokens) - 3
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.sort_array(
        F.transform(
            starts,
            lambda i: F.struct(
                F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("h"), i.alias("i")
            ),
        )
    )


def _repeated_words(tokens: Column) -> Column:
    """Words that lie in a window found twice or more."""

    def starts(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda w, j: (w["h"] == F.get(ordered, j - 1)["h"]) | (w["h"] == F.get(ordered, j + 1)["h"]),
        )
        return F.sort_array(F.transform(twice, lambda w: w["i"]))

    def covered(begin: Column) -> Column:
        # A window adds the words up to the next repeated window, at most its own three.
        own = F.transform(begin, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(begin, j + 1) - at, F.lit(3))))
        return F.aggregate(own, F.lit(0), lambda total, n: total + n)

    return let(_windows(tokens), lambda ordered: let(starts(ordered), covered))


def with_metrics(docs: DataFrame, text: str = "text", into: str = "metrics") -> DataFrame:
    """``docs`` with a struct of the five counts of each text."""
    split = docs.withColumns({f"{into}_words": words(F.col(text)), f"{into}_lines": _lines(F.col(text))})
    tokens, lines = F.col(f"{into}_words"), F.col(f"{into}_lines")
    counts = F.struct(
        F.size(tokens).cast("long").alias("n_words"),
        F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated_words(tokens).cast("long").alias("n_repeat_words"),
    )
    return split.withColumn(into, counts).drop(f"{into}_words", f"{into}_lines")


def base_failed(m: Column, rules: QualityRules) -> Column:
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])


def any_failed(m: Column, rules: QualityRules) -> Column:
    return (
        base_failed(m, rules)
        | (100 * m["n_symbols"] > rules.max_symbols_per_100_words * m["n_words"])
        | (100 * m["n_dup_lines"] > rules.max_dup_lines_per_100_words * m["n_words"])
    )


def host_verdicts(failures: DataFrame, rules: QualityRules) -> DataFrame:
    """From ``(host, failed)`` per document: ``host, n_docs, n_failed, rate, rejected``.

    The prior comes from the moments of the hosts' rates: their mean, and their variance less what chance alone would give.
    """
    hosts = stored(
        failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")),
        "hosts",
    )
    rate = F.col("n_failed") / F.col("n_docs")
    seen = hosts.agg(
        F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("chance")
    ).first()
    mean = seen["mean"] or 0.0
    spread = mean * (1 - mean)
    true_var = (seen["var"] or 0.0) - spread * (seen["chance"] or 0.0)
    weight = spread / true_var - 1 if true_var > 0 else rules.max_prior_documents
    weight = min(max(weight, rules.min_prior_documents), rules.max_prior_documents)
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("rate", shrunk).withColumn("rejected", F.col("rate") > rules.max_host_rate)


def judge(
    docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source", carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """One row per document: ``carry``, the counts, ``base_failed``, ``host_rejected`` and ``kept``.

    The measured rows are written once, with the carried columns only; hosts are then counted and joined from there. The host
    side has one row per host, so a host with a third of all rows costs one joined row; Spark splits its other side.
    """
    held = docs.select(F.struct(*carry).alias("carried"), F.col(host).alias("host"), F.col(text).alias("body"))
    measured = stored(with_metrics(held, "body", "m").drop("body"), "quality")
    m = F.col("m")
    verdicts = host_verdicts(measured.select("host", any_failed(m, rules).alias("failed")), rules)
    verdicts = verdicts.select(F.col("host").alias("judged"), F.col("rejected").alias("host_rejected"))
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("judged")), "left")
    failed = base_failed(m, rules)
    return joined.select(
        *[F.col("carried")[c].alias(c) for c in carry],
        *[m[c].alias(c) for c in METRICS],
        failed.alias("base_failed"),
        F.col("host_rejected"),
        (~failed & ~F.col("host_rejected")).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns. Extra columns of any name are carried along."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "source")
    return judge(whole, rules, carry=("row",)).where("kept").select("row.*")
