"""Checks on parameters, made on the driver before a job is built."""

from __future__ import annotations

import re
from collections.abc import Mapping

from textquarry.functions.filters import check_filter

# Limits that are part of the contract.
MAX_RESULTS = 500
MAX_QUERY_CHARS = 8192
MAX_DESCRIPTION_CHARS = 500
MAX_MODEL_CHARS = 256
COLLECTION_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*[A-Za-z0-9]")
COLLECTION_NAME_CHARS = (3, 512)
MODEL_NAME = re.compile(r"[a-zA-Z0-9][\w./\-]*")


def check_top_k(k: int) -> int:
    if k < 1:
        raise ValueError("the number of results must be at least 1")
    return k


def check_request(text: str, k: int, where: Mapping | None = None) -> None:
    """The tighter limits on a request from outside: length of the query text, number of results, size of the filter."""
    check_query_text(text)
    check_filter(where or {})
    if check_top_k(k) > MAX_RESULTS:
        raise ValueError(f"the number of results must be at most {MAX_RESULTS}")


def check_min_score(value: float | None) -> float | None:
    if value is not None and not 0.0 <= value <= 1.0:
        raise ValueError("min_score must be between 0 and 1")
    return value


def check_query_text(text: str) -> str:
    if not 1 <= len(text) <= MAX_QUERY_CHARS:
        raise ValueError(f"query text must have 1 to {MAX_QUERY_CHARS} characters")
    return text


def check_collection_name(name: str) -> str:
    low, high = COLLECTION_NAME_CHARS
    if not low <= len(name) <= high or not COLLECTION_NAME.fullmatch(name):
        raise ValueError(f"not a valid collection name: {name!r}")
    return name


def check_description(text: str) -> str:
    if len(text) > MAX_DESCRIPTION_CHARS:
        raise ValueError(f"a description is limited to {MAX_DESCRIPTION_CHARS} characters")
    return text


def check_model_name(name: str) -> str:
    if len(name) > MAX_MODEL_CHARS or not MODEL_NAME.fullmatch(name):
        raise ValueError(f"not a valid model name: {name!r}")
    return name
