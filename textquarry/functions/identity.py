"""Stable ids and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(source: Column, chunk: Column) -> Column:
    """Id of a file chunk: MD5 of ``source::chunk``."""
    return F.md5(F.concat_ws("::", source, chunk.cast("string")))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; the whole path where it lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)



def row_chunk_id(source: Column, row_id: Column, chunk: Column) -> Column:
    """Id of a row chunk: MD5 of ``sqlite::store::table::row::chunk``."""
    return F.md5(F.concat_ws("::", F.lit("sqlite"), source, F.coalesce(row_id.cast("string"), F.lit("None")), chunk.cast("string")))


def content_hash(content: Column) -> Column:
    """SHA-256 of the raw bytes, in hex."""
    return F.sha2(content, 256)


def row_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a row's text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def _row_json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def stable_row_id(*columns: Column) -> Column:
    """A key for rows without an id column: a hash of the row, the same on every run and every retry."""
    return F.sha2(_row_json(*columns), 256)


def row_mark(*columns: Column) -> Column:
    """A short hash of the row: rows of one ``stable_row_id`` have one mark, but a mark may have several ids."""
    return F.xxhash64(_row_json(*columns))


def existence_key(source: Column) -> Column:
    """What must exist for a chunk to stay: the store of a row source, else the source itself."""
    return F.when(source.contains("::"), F.split_part(source, F.lit("::"), F.lit(1))).otherwise(source)


def basename(source: Column) -> Column:
    """Last segment after ``/`` or a backslash."""
    return F.regexp_extract(source, r"[^/\\]*$", 0)


def cite_key(source: Column, index: Column) -> Column:
    """Basename without its last extension, other characters as ``_``, and the index."""
    stem = F.regexp_replace(basename(source), r"\.[^.]+$", "")
    return F.concat(F.regexp_replace(stem, "[^a-zA-Z0-9]+", "_"), F.lit("_"), index.cast("string"))


def suffix(path: Column) -> Column:
    """Lower-case suffix of a path with its dot, or ``""``."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))
