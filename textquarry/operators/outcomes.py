"""Reports on an ingest run, from its table of outcomes (one row per source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import materialize

# How many reasons are listed, and what follows the last one if there are more.
SKIP_REASON_LIMIT = 500
TRUNCATED = "(truncated — more than {limit} skipped entries)"

RUNNING_BLOCKS = 128


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """``sources_found, sources_ingested, sources_skipped, chunks_stored``."""
    ingested = F.col("status") == "ingested"
    return outcomes.agg(
        F.count(F.lit(1)).alias("sources_found"),
        F.count_if(ingested).alias("sources_ingested"),
        F.count_if(~ingested).alias("sources_skipped"),
        F.coalesce(F.sum(F.when(ingested, F.col("n_chunks"))), F.lit(0)).cast("long").alias("chunks_stored"),
    )


def skip_reasons(outcomes: DataFrame, limit: int = SKIP_REASON_LIMIT) -> DataFrame:
    """The first ``limit`` reasons in order as ``name: reason``, and one marker if there are more.

    The sort stops at ``limit + 1`` rows in each task, so only that many ever reach the list (``skipped_rows`` has them all). The outcomes are written
    first: their filter would be pushed down, and the extraction behind it run twice.
    """
    skipped = materialize(outcomes).where("coalesce(skip_reason, '') <> ''")
    first = skipped.orderBy("seq").limit(limit + 1)
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(": ", "name", "skip_reason").alias("line")))),
        lambda r: r["line"],
    )
    marker = F.array(F.lit(TRUNCATED.format(limit=limit)))
    return first.agg(listed.alias("all")).select(
        F.when(F.size("all") > limit, F.concat(F.slice("all", 1, limit), marker))
        .otherwise(F.col("all"))
        .alias("skipped_reasons")
    )


def skipped_rows(outcomes: DataFrame) -> DataFrame:
    """All skipped sources, ``seq, name, skip_reason`` a row each: no list and no limit, so any number of them will do."""
    return outcomes.where("coalesce(skip_reason, '') <> ''").select("seq", "name", "skip_reason")


def ingest_report(outcomes: DataFrame) -> DataFrame:
    """The summary and the capped list of skip reasons in one row."""
    outcomes = materialize(outcomes)
    return ingest_summary(outcomes).withColumn("skipped_reasons", skip_reasons(outcomes).scalar())


def running_totals(rows: DataFrame, order: str, values: dict[str, str], blocks: int = RUNNING_BLOCKS) -> DataFrame:
    """Running sums in the order of a unique column, without putting all rows in one task.

    The rows are cut into ``blocks`` ranges of the order column. A window runs inside each range; the sums of the
    ranges before it, at most ``blocks`` rows, are added. The cut points are one key per hash bucket, the one with the
    smallest second hash: spread like the keys themselves, and the same on each run. They only balance the work.
    """
    pick = F.xxhash64(F.col(order), F.lit(1))
    keys = rows.groupBy(F.pmod(F.xxhash64(order), F.lit(blocks - 1)).alias("b")).agg(
        F.min_by(F.col(order), pick).alias("cut")
    )
    cuts = keys.agg(F.array_sort(F.collect_list("cut")).alias("cuts")).scalar()
    block = F.size(F.filter(F.col("_cuts"), lambda c: c <= F.col(order)))
    placed = rows.withColumn("_cuts", cuts).withColumn("_block", block).drop("_cuts")

    totals = placed.groupBy("_block").agg(*[F.sum(v).alias(f"_t_{name}") for name, v in values.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_block", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"_l_{n}": F.sum(v).over(inside) for n, v in values.items()})
    # At most one row per block: the bound on this broadcast is the number of blocks.
    joined = local.join(F.broadcast(offsets), "_block")
    return joined.select(*rows.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in values])


def ingest_progress(outcomes: DataFrame, blocks: int = RUNNING_BLOCKS) -> DataFrame:
    """One progress row per source: ``seq, filename, files_done, files_total, status, chunks_stored``.

    The outcomes are read four times, so they are written to the shared folder first.
    """
    outcomes = materialize(outcomes)
    counted = outcomes.withColumns(
        {"_one": F.lit(1), "_stored": F.when(F.col("status") == "ingested", F.col("n_chunks")).otherwise(F.lit(0))}
    )
    totals = running_totals(counted, "seq", {"files_done": "_one", "chunks_stored": "_stored"}, blocks)
    found = outcomes.agg(F.count(F.lit(1)).alias("n")).scalar()
    return totals.select(
        "seq",
        F.col("name").alias("filename"),
        "files_done",
        found.alias("files_total"),
        "status",
        "chunks_stored",
    )
