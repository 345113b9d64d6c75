"""Metadata filters given as nested dicts, compiled to one Column that Catalyst can push down."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import chain
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits on a request from outside.
MAX_DEPTH = 5
MAX_KEYS = 20
MAX_ITEMS = 50


def _levels(node) -> Iterator[tuple[int, object]]:
    """Every value of a nested filter with its depth, level by level."""
    level, depth = [node], 0
    while level:
        yield from ((depth, value) for value in level)
        maps = [list(v.values()) for v in level if isinstance(v, Mapping)]
        lists = [v for v in level if isinstance(v, (list, tuple))]
        level, depth = list(chain.from_iterable(maps + lists)), depth + 1


def check_filter(where: Mapping) -> None:
    """Limits on the size of a filter from outside."""
    for depth, value in _levels(where):
        if depth > MAX_DEPTH:
            raise ValueError(f"filter is nested deeper than {MAX_DEPTH}")
        if isinstance(value, Mapping) and len(value) > MAX_KEYS:
            raise ValueError(f"filter object has more than {MAX_KEYS} keys")
        if isinstance(value, (list, tuple)) and len(value) > MAX_ITEMS:
            raise ValueError(f"filter list has more than {MAX_ITEMS} items")


def _comparable(value, dtype: T.DataType | None) -> bool:
    """Whether a value can equal one of a column's type; an unknown type takes any."""
    if dtype is None or value is None:
        return True
    if isinstance(value, bool) or isinstance(dtype, T.BooleanType):
        return isinstance(value, bool) and isinstance(dtype, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(dtype, T.NumericType)
    return not isinstance(dtype, T.NumericType)


def _test(col: Column | None, dtype: T.DataType | None, op: str, value) -> Column:
    """One comparison; a missing field, or a value of another type, fails every positive test and passes the negated ones."""
    if op in ("$in", "$nin"):
        if not isinstance(value, Sequence) or isinstance(value, str):
            raise ValueError(f"{op} needs a list")
        value = [v for v in value if _comparable(v, dtype)]
        usable = col is not None and bool(value)
    else:
        usable = col is not None and _comparable(value, dtype)
    if op in ("$ne", "$nin"):
        if not usable:
            return F.lit(True)
        return col.isNull() | (col != value if op == "$ne" else ~col.isin(value))
    tests = {
        "$eq": lambda c: c == value,
        "$in": lambda c: c.isin(value),
        "$gt": lambda c: c > value,
        "$gte": lambda c: c >= value,
        "$lt": lambda c: c < value,
        "$lte": lambda c: c <= value,
    }
    if op not in tests:
        raise ValueError(f"unknown filter operator {op!r}")
    return tests[op](col) if usable else F.lit(False)


def _compile(node: Mapping, columns: Mapping[str, T.DataType | None]) -> Column:
    parts = []
    for key, value in node.items():
        if key in ("$and", "$or"):
            if not isinstance(value, Sequence) or isinstance(value, str) or not value:
                raise ValueError(f"{key} needs a non-empty list of filters")
            parts.append(reduce(and_ if key == "$and" else or_, [_compile(v, columns) for v in value]))
        elif key.startswith("$"):
            raise ValueError(f"unknown filter operator {key!r}")
        else:
            col = F.col(f"`{key}`") if key in columns else None
            tests = value if isinstance(value, Mapping) else {"$eq": value}
            parts.extend(_test(col, columns.get(key), op, v) for op, v in tests.items())
    if not parts:
        raise ValueError("empty filter object")
    return reduce(and_, parts)


def compile_where(where: Mapping | None, columns: T.StructType | Sequence[str]) -> Column | None:
    """Compile ``{"lang": {"$in": ["en", "de"]}}`` and the like; ``None`` or ``{}`` filters nothing.

    ``columns`` is the schema of what is filtered, or its names alone. A filter may have any size here; the limits on
    one from outside are those of ``check_filter``.
    """
    if not where:
        return None
    known = {f.name: f.dataType for f in columns.fields} if isinstance(columns, T.StructType) else dict.fromkeys(columns)
    return _compile(where, known)


def of_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of the sources in a table, of any number."""
    return chunks.join(sources.select("source").distinct(), "source", "left_semi").select(*chunks.columns)


def source_contains(source: Column, needle: str) -> Column:
    """Case-insensitive substring search on the source; a blank needle keeps everything."""
    needle = needle.strip().lower()
    return F.contains(F.lower(source), F.lit(needle)) if needle else F.lit(True)
