"""Tables as sources: any catalog table, JDBC relation or DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.errors import TableNotFoundError
from textquarry.functions.identity import row_mark, stable_row_id
from textquarry.session import materialize

ROW_ID = "_row_id"
NO_ID = "None"  # fixed value: the key of a row whose id is null
_COPY = "_copy"
_MARK = "_mark"
COPY_BLOCK = 100_000


@dataclass(frozen=True)
class TableScan:
    """Rows with their key in ``_row_id``, and the columns that make up the text."""

    rows: DataFrame
    columns: list[str]
    id_column: str | None


def open_table(spark: SparkSession, name: str) -> DataFrame:
    try:
        return spark.table(name)
    except AnalysisException as error:
        if error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
            raise TableNotFoundError(f"table not found: {name}") from None
        raise


def scan_table(table: DataFrame, columns: list[str] | None = None, id_column: str = "id") -> TableScan:
    """Select the text columns and the row key; only these reach the scan.

    The key is read even where ``columns`` leaves it out. Without the id column it is a hash of the whole row, the
    same on each run and each retry; further copies of an equal row get their number appended.
    """
    missing = [c for c in columns or [] if c not in table.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {table.columns}")
    selected = list(columns or table.columns)
    content = [F.col(f"`{c}`") for c in selected]
    if id_column in table.columns:
        row_id = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(NO_ID))
        return TableScan(table.select(row_id.alias(ROW_ID), *content), selected, id_column)
    whole = [F.col(f"`{c}`") for c in table.columns]
    rows = _number_copies(table.select(stable_row_id(*whole).alias(ROW_ID), row_mark(*whole).alias(_MARK), *content))
    copy = F.when(F.col(_COPY) > 0, F.concat(F.lit("#"), F.col(_COPY).cast("string"))).otherwise(F.lit(""))
    return TableScan(rows.select(F.concat(ROW_ID, copy).alias(ROW_ID), *content), selected, None)


def _number_copies(rows: DataFrame) -> DataFrame:
    """Number equal rows 0, 1, … without gathering them. Marks are counted, combined before the shuffle, and only rows of a repeated
    mark are counted by their keys; a row without copies does not move. Of one with copies, one row is unfolded, in blocks that are
    spread over tasks first."""
    marks = materialize(rows.groupBy(_MARK).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(_MARK))
    if marks.isEmpty():
        return rows.drop(_MARK).withColumn(_COPY, F.lit(0).cast("long"))
    rows, alike = rows.drop(_MARK), rows.join(marks, _MARK, "left_semi").drop(_MARK)
    counted = materialize(alike.groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    single = rows.join(counted, ROW_ID, "left_anti").withColumn(_COPY, F.lit(0).cast("long"))
    several = alike.join(counted, ROW_ID, "left_semi").dropDuplicates([ROW_ID]).join(counted, ROW_ID)
    blocks = several.withColumn("_from", F.explode(F.expr(f"sequence(0L, _n - 1, {COPY_BLOCK}L)"))).repartition(ROW_ID, "_from")
    unfolded = blocks.withColumn(_COPY, F.explode(F.expr(f"sequence(_from, least(_from + {COPY_BLOCK}L, _n) - 1)")))
    return single.unionByName(unfolded.drop("_n", "_from"))
