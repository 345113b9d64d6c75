"""Text to vectors: a registry of Arrow UDF factories by model name, and a model that needs no download."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.validation import check_model_name

DEFAULT_MODEL = "hashed-words-256"
_TOKEN_BREAK = re.compile("[ \n.,]+")

Encoder = Callable[[pd.Series], list]


@lru_cache(maxsize=1 << 17)
def _slot(token: str, dims: int) -> int:
    """Dimension of a token: the first 32 bits of its MD5, modulo the width."""
    return int(hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()[:8], 16) % dims


def _hashed_words(dims: int) -> Encoder:
    def encode(texts: pd.Series) -> list:
        out = []
        for text in texts:
            slots = [_slot(token, dims) for token in _TOKEN_BREAK.split(text or "") if token]
            counts = np.bincount(slots, minlength=dims) if slots else np.zeros(dims)
            length = np.sqrt(float(np.dot(counts, counts)))
            out.append((counts / length if length else counts).astype(np.float32))
        return out

    return encode


# Model name -> factory. The factory runs once per Python worker, so a heavy model is loaded there and kept.
_FACTORIES: dict[str, Callable[[], Encoder]] = {DEFAULT_MODEL: lambda: _hashed_words(256)}
_LOADED: dict[str, Encoder] = {}


def register_embedder(name: str, factory: Callable[[], Encoder]) -> None:
    """Add a model: ``factory()`` gives a function from a batch of texts to a list of vectors."""
    _FACTORIES[check_model_name(name)] = factory


def embed(text: Column, model: str = DEFAULT_MODEL) -> Column:
    """``array<float>`` of each text, computed in Arrow batches."""
    if model not in _FACTORIES:
        raise ValueError(f"unknown embedding model {model!r}; known: {sorted(_FACTORIES)}")
    factory = _FACTORIES[model]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        encoder = _LOADED.get(model) or _LOADED.setdefault(model, factory())
        return pd.Series(encoder(texts), index=texts.index, dtype=object)

    return encode(text)
