"""CSV and JSON-lines: one text per file, or one text per record from splittable input."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import flatten_json, scalars, strip


# A file's text, or what kept it from being read: one bad file must not end a job.
READ = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def _records(body: str) -> Iterator[list[str]]:
    csv.field_size_limit(2**31 - 1)  # a field may be as long as its file
    return csv.reader(io.StringIO(body, newline=""))


def _read_each(bodies: pd.Series, read: Callable[[str], str]) -> pd.DataFrame:
    rows = []
    for body in bodies:
        try:
            rows.append((None if body is None else read(body), None))
        except Exception as error:
            rows.append((None, f"{type(error).__name__}: {error}"))
    return pd.DataFrame(rows, columns=READ.names, dtype=object)


@F.pandas_udf(READ)
def csv_text(files: pd.Series) -> pd.DataFrame:
    """A CSV file as text: fields joined by a comma and a space, rows by a newline."""
    return _read_each(files, lambda body: "\n".join(", ".join(fields) for fields in _records(body)))


def _json_line(line: str) -> str | None:
    try:
        return scalars(json.loads(line))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(READ)
def json_lines_text(files: pd.Series) -> pd.DataFrame:
    """A JSON-lines file as text: one line per valid record; blank, invalid and too deeply nested lines are dropped."""
    return _read_each(files, lambda body: "\n".join(t for t in map(_json_line, body.split("\n")) if t is not None))


def scan_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line records of files of any size: Spark splits a file over tasks, no file is held whole."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def scan_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One flattened text per valid JSON line; blank and invalid lines are dropped."""
    lines = scan_text_lines(spark, path).select(strip(F.col("line")).alias("line")).where("line <> ''")
    return lines.select(flatten_json("line").alias("text")).where("text is not null")


@F.pandas_udf(T.StringType())
def _csv_record(lines: pd.Series) -> pd.Series:
    def fields(line: str) -> str:
        return ", ".join(next(_records(line), []))

    return lines.map(fields, na_action="ignore")


def scan_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """One text per line of CSV, all its fields joined by a comma and a space, however many it has; a blank line is a
    blank text. The header, if any, is a record. Spark splits the files by line, so a quoted field must not hold a
    newline; a file with such fields is read whole, by ``csv_text``."""
    return scan_text_lines(spark, path).select(_csv_record("line").alias("text"))
