"""Work on ranked hits: citations, neighbours, answer context and prompts, recent queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Our own wording of the fixed instruction.
INSTRUCTION = (
    "Answer the question from the context below and from nothing else. "
    "Keep the answer short. If the context does not hold the answer, say that it does not."
)


def cited_sources(hits: DataFrame) -> DataFrame:
    """The best hit of each source, per query."""
    first = Window.partitionBy("qid", "source").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def hit_neighbours(hits: DataFrame) -> DataFrame:
    """Add ``previous_id`` and ``next_id``; at the ends of the list a hit is its own neighbour."""
    order = Window.partitionBy("qid").orderBy("rank")
    return hits.withColumns(
        {
            "previous_id": F.coalesce(F.lag("id").over(order), F.col("id")),
            "next_id": F.coalesce(F.lead("id").over(order), F.col("id")),
        }
    )


def ordered_join(value: Column, order: Column, separator: str) -> Column:
    """Aggregate: texts joined in rank order. A group is one query, so it holds at most k hits per collection."""
    ranked = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(ranked, lambda r: r["v"]), separator)


def answer_context(hits: DataFrame) -> DataFrame:
    """``qid, context``: texts of a query's hits in rank order, a blank line between them. No hits, no row."""
    return hits.groupBy("qid").agg(ordered_join(F.col("text"), F.col("rank"), "\n\n").alias("context"))


def answer_prompt(context: DataFrame, prefix: str | None = None) -> DataFrame:
    """Add ``prompt``: the user's own prefix if any, the instruction, and the context."""
    lead = f"{prefix.strip()}\n\n" if prefix and prefix.strip() else ""
    return context.withColumn("prompt", F.concat(F.lit(f"{lead}{INSTRUCTION}\n\nCONTEXT:\n"), F.col("context")))


def generate_answers(prompts: DataFrame, generator) -> DataFrame:
    """Add ``answer`` by a pandas UDF the caller supplies (prompt to text). There is no default generator."""
    return prompts.withColumn("answer", generator(F.col("prompt")))


def recent_distinct(log: DataFrame, user: str, text: str, ts: str, cap: int = 20) -> DataFrame:
    """Most recent distinct texts of each user, newest first, at most ``cap``.

    Repeats collapse to their latest use before anything is ranked.
    """
    latest = log.groupBy(user, text).agg(F.max(ts).alias("last_used"))
    order = Window.partitionBy(user).orderBy(F.desc("last_used"), text)
    return latest.withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap)
