"""Benchmark decontamination: an FM-index per shard of training documents is searched for the phrases of the benchmark.

A shard is what one task holds at a time (an Arrow batch, bounded by rows and bytes). Its index is over word ids of the benchmark's
own vocabulary; any other word ends a segment, and a segment shorter than the shortest phrase holds no phrase and is left out, so
the index is small though every word of every text is read. All phrases are searched backwards at once through wavelet-matrix
ranks, occurrences are located by sampled suffix positions, and their spans are merged per document. Documents do not move.

The benchmark is a stated query set. Its bytes are counted first, and it is sent to the tasks in blocks of at most
``block_bytes``; with several blocks the documents are read once per block and the spans are merged by document.

Nulls: a null text has no words; a null item id is reported as no item, but its windows count; a null document id is kept. Repeated
rows each get a row. Items of fewer than ``window`` words are one phrase, items without words none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_batches
from textquarry.llm.fm_index import FMIndex

# Bytes that are no part of a word become spaces, A-Z become a-z, bytes of 0x80 and above stay.
_SPACES = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
FOLD = bytes.maketrans(_SPACES + _UPPER, b" " * len(_SPACES) + _UPPER.lower())

HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>, items array<string>, tag long"


def word_bytes(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Phrases:
    """The distinct windows of some items as right-aligned rows of word ids, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids: dict[bytes, int] = {}
        known: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in word_bytes(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                known.setdefault(tuple(ids[i : i + window]), set()).update([] if item is None else [item])
        width = max(map(len, known), default=0)
        self.rows = np.zeros((len(known), width), np.int64)
        self.lengths = np.zeros(len(known), np.int64)
        self.items = list(known.values())
        for i, phrase in enumerate(known):
            self.rows[i, width - len(phrase) :] = phrase
            self.lengths[i] = len(phrase)
        self.shortest = int(self.lengths.min()) if known else 0


def find_spans(texts: list[str | None], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(word counts, phrase, first word, document)``: of every occurrence in one shard, words counted over the whole shard."""
    known = phrases.ids.get
    parts = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = word_bytes(text)
        counts[i] = len(found)
        parts.append(np.fromiter(map(known, found, repeat(0)), np.int32, len(found)))
        parts.append(np.zeros(1, np.int32))  # documents end a segment
    none = np.zeros(0, np.int64)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    if not len(phrases.rows) or not len(tokens):
        return counts, none, none, none
    # Segments are runs of known words; only those that can hold a phrase are indexed, each with the 0 behind it.
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (tokens > 0).view(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    long_enough = end - begin >= phrases.shortest
    begin, size = begin[long_enough], (end - begin)[long_enough] + 1
    if not len(begin):
        return counts, none, none, none
    offset = np.cumsum(size) - size
    place = np.arange(int(size.sum())) + np.repeat(begin - offset, size)
    index = FMIndex(tokens[place], len(phrases.ids) + 1)
    low, high = index.search(phrases.rows, phrases.lengths)
    n = high - low
    phrase = np.repeat(np.arange(len(n)), n)
    rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    at = place[index.locate(rows)]
    doc_start = np.cumsum(counts + 1) - (counts + 1)
    doc = np.searchsorted(doc_start, at, side="right") - 1
    return counts, phrase, at - doc, doc  # one separator for each document before


def merged_spans(first: np.ndarray, length: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans over ``n_words`` words as ``(starts, ends)``."""
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    inside = np.concatenate(([0], (np.cumsum(change) > 0).view(np.int8), [0]))
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def _hit_rows(ids: pa.Array, tags: pa.Array, texts: list[str | None], phrases: Phrases) -> pa.RecordBatch:
    counts, phrase, first, doc = find_spans(texts, phrases)
    starts = np.cumsum(counts) - counts
    spans: list[list[dict]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        d = int(doc[group[0]])
        a, b = merged_spans(first[group] - starts[d], phrases.lengths[phrase[group]], int(counts[d]))
        spans[d] = [{"start": int(x), "end": int(y)} for x, y in zip(a, b)]
        items[d].update(*[phrases.items[p] for p in np.unique(phrase[group])])
    hit = [sum(s["end"] - s["start"] for s in each) for each in spans]
    named = [sorted(each) for each in items]
    return pa.RecordBatch.from_arrays(
        [
            ids.cast(pa.int64()),
            pa.array(counts),
            pa.array(hit, pa.int64()),
            pa.array(list(map(len, named)), pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()),
            pa.array([h > 0 for h in hit], pa.bool_()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array(named, pa.list_(pa.string())),
            tags,
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items", "tag"],
    )


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of about ``block_bytes`` of text, one block on the driver at a time."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("body"))
    total = items.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == i) if n > 1 else items
        yield [tuple(r) for r in part.collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per document: counts, the items found, and the merged word spans to remove (see ``HITS``)."""
    # Rows of the same id and text share a tag (and a result): it tells rows with equal or null ids apart when blocks are merged.
    key, body = F.col(doc_id).cast("long"), F.col(text)
    held = docs.select(key.alias("doc_id"), body.alias("body"), F.xxhash64(key, body).alias("tag"))

    def searched(block: list[tuple[str | None, str | None]]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))

        def work(batches):
            for batch in batches:
                yield _hit_rows(batch.column(0), batch.column(2), batch.column(1).to_pylist(), sent.value)

        return map_batches(held, work, HITS)

    parts = [searched(block) for block in _blocks(benchmark, item_id, item_text, block_bytes)]
    return parts[0] if len(parts) == 1 else _merge_blocks(parts)


def _merge_blocks(parts: list[DataFrame]) -> DataFrame:
    """Spans and items of all blocks by document; the gathered lists hold what one document holds."""
    key = ["tag", "n_words"]
    found = parts[0].where("contaminated").select(*key, "spans", "items")
    for part in parts[1:]:
        found = found.unionByName(part.where("contaminated").select(*key, "spans", "items"))
    # Repeated rows bring equal lists: one of each is enough.
    merged = found.dropDuplicates().groupBy(*key).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    no_spans = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda done: F.element_at(done, -1)
    union = F.aggregate(
        "spans",
        no_spans,
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    base = parts[0].select("doc_id", "n_words", "tag")
    both = base.join(merged.select(*key, union.alias("spans"), "items"), key, "left")
    spans = F.coalesce("spans", no_spans)
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return both.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        spans.alias("spans"), items.alias("items"), "tag",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark, with their own columns. Texts are filtered where they
    are read, block by block of the benchmark, and do not move."""
    kept = docs
    for block in _blocks(benchmark, "item_id", "text", block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))
        at = docs.columns.index("text")

        def work(batches, sent=sent):
            for batch in batches:
                _, _, _, doc = find_spans(batch.column(at).to_pylist(), sent.value)
                clean = np.ones(batch.num_rows, bool)
                clean[doc] = False
                yield batch.filter(pa.array(clean))

        kept = map_batches(kept, work, kept.schema)
    return kept
