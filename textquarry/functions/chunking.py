"""Overlapping text windows, snapped to words or to sentences.

The number of windows depends on the text, so the walk is an Arrow UDF; sentences are split in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.text import sentences


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes are in characters."""

    chunk_size: int = 1000
    overlap: int = 200
    min_chunk_size: int = 50
    mode: str = "word"

    def __post_init__(self):
        if self.chunk_size < 1 or self.overlap < 0 or self.min_chunk_size < 1:
            raise ValueError("chunk_size and min_chunk_size must be at least 1, overlap at least 0")
        if self.overlap >= self.chunk_size:
            raise ValueError(f"overlap ({self.overlap}) must be below chunk_size ({self.chunk_size})")
        if self.mode not in ("word", "sentence"):
            raise ValueError(f"mode must be 'word' or 'sentence', not {self.mode!r}")


def _windows(text: str, opts: ChunkOptions) -> Iterator[str]:
    """Windows over text whose white space is already normalised, short ones left out.

    A window stops at its last space, if it has one past its first character, unless it reaches the end of the text.
    The next one begins ``overlap`` before that stop, or a full stride on where the stop leaves no progress.
    """
    at, stride = 0, opts.chunk_size - opts.overlap
    while at < len(text):
        stop = at + opts.chunk_size
        if stop < len(text):
            space = text.rfind(" ", at + 1, stop)
            stop = space if space > 0 else stop
        window = text[at:stop].strip(" ")
        if len(window) >= opts.min_chunk_size:
            yield window
        at = stop - opts.overlap if stop - opts.overlap > at else at + stride


def _tail(group: list[str], budget: int) -> list[str]:
    """The longest run of closing sentences that fits the overlap, one separator each."""
    kept = 0
    for sentence in reversed(group):
        budget -= len(sentence) + 1
        if budget < 0:
            break
        kept += 1
    return group[len(group) - kept :]


def _sentence_groups(parts, opts: ChunkOptions) -> Iterator[str]:
    """Fill windows with whole sentences; a sentence longer than a window is cut by words."""

    def joined(group):
        text = " ".join(group)
        return [text] if group and len(text) >= opts.min_chunk_size else []

    group: list[str] = []
    filled = 0  # characters of the group, a separator each
    for part in parts:
        if len(part) > opts.chunk_size:
            yield from joined(group)
            yield from _windows(" ".join(part.split()), opts)
            group, filled = [], 0
            continue
        if group and filled + len(part) + 1 > opts.chunk_size:
            yield from joined(group)
            group = _tail(group, opts.overlap)
            filled = sum(len(s) + 1 for s in group)
        group.append(part)
        filled += len(part) + 1
    yield from joined(group)


def chunk_words(text: Column, opts: ChunkOptions = ChunkOptions()) -> Column:
    """``array<string>`` of word-snapped windows."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(_windows(" ".join(t.split()), opts)) if t else [])

    return windows(text)


def chunk_sentences(text: Column, opts: ChunkOptions = ChunkOptions(mode="sentence")) -> Column:
    """``array<string>`` of sentence-snapped windows."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def groups(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: list(_sentence_groups(p, opts)) if p is not None else [])

    return groups(sentences(text))


def chunk_text(text: Column, opts: ChunkOptions = ChunkOptions()) -> Column:
    return chunk_sentences(text, opts) if opts.mode == "sentence" else chunk_words(text, opts)
