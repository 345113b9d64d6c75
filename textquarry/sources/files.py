"""Folders and path lists as DataFrames, and the extraction of text and metadata from their bytes."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.errors import SourceNotFoundError
from textquarry.functions import text as tx
from textquarry.functions.identity import suffix
from textquarry.session import materialize
from textquarry.sources.archives import read_archives
from textquarry.sources.records import csv_text, json_lines_text

# File suffixes by the way their text is read.
TEXT_SUFFIXES = (".txt", ".md")
HTML_SUFFIXES = (".html", ".htm")
ARCHIVE_SUFFIXES = (".docx", ".pptx", ".xlsx", ".epub", ".odt")
SUPPORTED_SUFFIXES = (*TEXT_SUFFIXES, ".csv", ".json", ".jsonl", *HTML_SUFFIXES, *ARCHIVE_SUFFIXES)


# Further formats by suffix: bytes to a struct of text, title, author, created and error.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {}
EXTRACTED = ("text", "title", "author", "created", "error")


def register_extractor(extractor: Callable[[Column], Column], *suffixes: str) -> None:
    """Read files of further suffixes (``.xyz``) with a column function, which gets a null for files of other kinds. It
    returns a struct with the fields ``EXTRACTED``, all strings; it comes before the built-in way for its suffixes."""
    EXTRACTORS.update(dict.fromkeys((s.lower() for s in suffixes), extractor))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*SUPPORTED_SUFFIXES, *EXTRACTORS)


def _plain_path(path: Column) -> Column:
    """Local paths without the ``file:`` scheme; other schemes are kept."""
    return F.regexp_replace(path, "^file:/+", "/")


def stored_path(source: str) -> str:
    """A local path as a collection stores it: absolute, without scheme. Tables (``::``) and other schemes stay."""
    if "::" in source or re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]+:", source):
        return source
    return os.path.abspath(re.sub(r"^file:/+", "/", source))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below ``folder``: ``path, modified, length, content``. Unused columns are never read.

    Spark's file source does not list files of zero bytes, so they count as not there; nor does one count that is deleted
    after it was listed.
    """
    try:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
        found = reader.load(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise SourceNotFoundError(f"source folder not found: {folder}") from None
        raise
    return found.select(
        _plain_path(F.col("path")).alias("path"),
        F.col("modificationTime").alias("modified"),
        "length",
        "content",
    )


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """The supported files below ``folder``, whatever the case of their suffix."""
    return list_files(spark, folder).where(is_supported(F.col("path")))


def scan_paths(requested: DataFrame, listing: DataFrame) -> DataFrame:
    """Requested paths against a listing: a missing or unsupported path becomes a skip reason, not an error."""
    there = listing.select("path", F.lit(True).alias("_found"))
    judged = requested.select("path").distinct().join(there, "path", "left").withColumn(
        "skip_reason",
        F.when(F.col("_found").isNull(), F.lit("extract_error: file not found")).when(
            ~is_supported(F.col("path")), F.lit("extract_error: unsupported format")
        ),
    )
    # Paths alone are compared; contents are then picked by the paths that stay, and no other file is opened.
    judged = materialize(judged.drop("_found"))
    read = listing.join(judged.where("skip_reason is null"), "path")
    return read.unionByName(judged.where("skip_reason is not null"), allowMissingColumns=True)


def extract_files(files: DataFrame) -> DataFrame:
    """``path, content, …`` to the same columns without ``content``, plus ``text, doc_title, doc_author,
    doc_created, error``.

    Plain text, HTML and their metadata are JVM expressions. JSON, CSV and archives, which need a parser, are Arrow
    UDFs that get only the bytes of their own kind: the other rows pass them a null.
    """
    kind = suffix(F.col("path"))
    keep = [c for c in files.columns if c != "content"]

    def of(*suffixes: str) -> Column:
        return F.when(kind.isin(*suffixes), F.col("content"))

    page = tx.utf8_text(of(*HTML_SUFFIXES))
    parsed = files.withColumns(
        {
            "_archive": read_archives(F.when(kind.isin(*ARCHIVE_SUFFIXES), kind), of(*ARCHIVE_SUFFIXES)),
            "_json": tx.flatten_json(tx.utf8_text(of(".json"))),
            "_jsonl": json_lines_text(tx.utf8_text(of(".jsonl"))),
            "_csv": csv_text(tx.utf8_text(of(".csv"))),
        }
    )
    archive = F.col("_archive")
    text = (
        F.when(kind.isin(*TEXT_SUFFIXES), tx.utf8_text(F.col("content")))
        .when(kind.isin(*HTML_SUFFIXES), tx.html_to_text(page))
        .when(kind == ".json", F.col("_json"))
        .when(kind == ".jsonl", F.col("_jsonl.text"))
        .when(kind == ".csv", F.col("_csv.text"))
        .when(kind.isin(*ARCHIVE_SUFFIXES), archive["text"])
    )
    given = F.lit(None).cast("struct<text:string,title:string,author:string,created:string,error:string>")
    for extractor in dict.fromkeys(EXTRACTORS.values()):
        own = of(*[s for s, e in EXTRACTORS.items() if e is extractor])
        given = F.when(own.isNotNull(), F.struct(*[extractor(own)[f].alias(f) for f in EXTRACTED])).otherwise(given)
    other = kind.isin(*EXTRACTORS) if EXTRACTORS else F.lit(False)
    text = F.when(other, given["text"]).otherwise(text)
    error = (
        F.when(F.col("content").isNull(), F.lit("file not found"))
        .when(other, given["error"])
        .when(~kind.isin(*SUPPORTED_SUFFIXES), F.lit("unsupported format"))
        .when((kind == ".json") & F.col("_json").isNull(), F.lit("invalid JSON"))
        .when(kind == ".jsonl", F.col("_jsonl.error"))
        .when(kind == ".csv", F.col("_csv.error"))
        .when(kind.isin(*ARCHIVE_SUFFIXES), archive["error"])
    )
    html_only = kind.isin(*HTML_SUFFIXES) & ~other

    def about(field: str, of_page: Column) -> Column:
        return F.when(html_only, of_page).otherwise(F.coalesce(given[field], archive[field], F.lit("")))

    return parsed.select(
        *keep,
        text.alias("text"),
        about("title", tx.html_title(page)).alias("doc_title"),
        about("author", tx.html_author(page)).alias("doc_author"),
        about("created", F.lit("")).alias("doc_created"),
        error.alias("error"),
    )
