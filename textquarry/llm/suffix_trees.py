"""Substring deduplication with prefix-partitioned suffix trees over words.

A word goes when a window of ``length`` (50) words that covers it also starts in a document with a smaller id.

1. Every text is read once. In each window the eight-word group of least hash is its anchor; equal windows have equal anchors at
   equal places, so suffixes that begin at anchors are all that is needed (about one word in twenty).
2. Suffixes are split by prefix: the anchor's eight words. Prefixes that occur in one text only hold no repeat and go no further.
   What stays is the stretch of text under the windows of each anchor.
3. A prefix with at most ``max_group`` windows fits in memory. Tasks get whole groups, sort the suffixes of their stretches to the
   depth of a window (prefix doubling), and read off the internal nodes of the subtree at that depth: runs of suffixes that agree so
   far. A node with suffixes of several documents is a repeat; all of its windows but those of its smallest document go.
4. A prefix with more windows (a line that a third of all documents share) is made longer at once, to the whole window: each such
   window is its own group, named by two 64-bit hashes, and its smallest document is found by partial aggregation. No group gathers.
5. Adjacent windows are joined to spans (the maximal repeats), grouped by text, and cut out.

Equal texts are one text here: a copy loses all words if it has a window at all, without being searched. Null document ids count as
greater than any other and not as smaller than each other; rows of one id do not count against each other. Null texts have no
words. Repeated rows get equal rows. An empty table gives an empty table. Equal texts are told by their MD5.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_batches, stored

GRAM = 8
NO_ID = (1 << 63) - 1
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _gram_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the eight words from each place on (0 where fewer follow)."""
    n = max(0, len(h) - GRAM + 1)
    total = np.zeros(n, np.uint64)
    for j in range(GRAM):
        total = total * _ODD[0] + h[j : j + n]
    total ^= total >> np.uint64(29)
    total *= _ODD[1]
    return total ^ (total >> np.uint64(32))


def anchors(h: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, anchor hash, first window, last window)`` of some documents whose word hashes follow each other in ``h``."""
    none = np.zeros(0, np.int64)
    width = length - GRAM + 1  # eight-word groups in a window
    grams = _gram_hashes(h)
    if len(grams) < width:
        return none, none.astype(np.uint64), none, none
    # Least hash first, then the leftmost: the place is in the lower half.
    least = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    end = np.cumsum(sizes)
    windows = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    at_all = at + np.repeat(end - sizes, windows)
    place = place[at_all]
    if not len(doc):
        return none, none.astype(np.uint64), none, none
    # Windows in a row whose anchors are the same words go together, so a text that repeats a few words has few anchors.
    prefix = grams[place]
    first = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((first[1:] - 1, [len(doc) - 1]))
    return doc[first], prefix[first], at[first], at[last]


def _lists(doc: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(doc, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


TEXTS = "id long, digest binary, n_words int, whole string, hashes array<long>, firsts array<int>, lasts array<int>"


def _read(length: int):
    def work(batches):
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                split = [split_words(t) for t in batch.column(2).to_pylist()]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                doc, gram, first, last = anchors(_word_hashes(list(chain.from_iterable(split))), sizes, length)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(sizes, pa.int32()),
                        pa.array(map(kept_digest, split), pa.string()),
                        _lists(doc, len(split), gram.view(np.int64), pa.int64()),
                        _lists(doc, len(split), first, pa.int32()),
                        _lists(doc, len(split), last, pa.int32()),
                    ],
                    ["id", "digest", "n_words", "whole", "hashes", "firsts", "lasts"],
                )

    return work


STRETCHES = "prefix long, id long, digest binary, first int, n int, words binary"


def _stretches(length: int):
    """For each kept anchor of a text the words under its windows."""

    def work(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for id_, digest, text, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = split_words(text)
                for a in at:
                    first, n = a["first"], a["last"] - a["first"] + 1
                    for column, value in zip(out, (a["prefix"], id_, digest, first, n, b" ".join(words[first : first + n + length - 1]))):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield _stretch_batch(out)
                    out = [[] for _ in range(6)]
            if out[0]:
                yield _stretch_batch(out)

    return work


def _stretch_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    names = ["prefix", "id", "digest", "first", "n", "words"]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks: the order of suffixes by twice the depth."""
    key = first * np.int64(int(second.max()) + 1) + second
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    return rank


def subtree_nodes(tokens: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes at ``starts`` (each with ``depth`` words to go): their order, and the node at that depth each hangs below."""
    rank, span = tokens, 1
    while 2 * span <= depth:
        rank = _named(rank[:-span], rank[span:])
        span *= 2
    node = rank[starts] if span == depth else _named(rank[starts], rank[starts + depth - span])
    order = np.argsort(node, kind="stable")
    return order, node[order]


def _repeats_of(rows: list[list], length: int) -> pa.RecordBatch | None:
    """Spans that go, from the stretches of some whole groups."""
    _, ids, digests, firsts, ns, texts = rows
    split = [t.split(b" ") for t in texts]
    flat = list(chain.from_iterable(split))
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    tokens = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    size = np.fromiter(map(len, split), np.int64, len(split))
    n = np.array(ns, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    order, node = subtree_nodes(tokens, inside + np.repeat(np.cumsum(size) - size, n), length)
    owner = np.array(ids, np.int64)[row[order]]
    head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    smallest = np.repeat(np.minimum.reduceat(owner, head), np.diff(np.concatenate((head, [len(node)]))))
    gone = np.zeros(len(row), bool)
    gone[order[owner > smallest]] = True
    at = np.flatnonzero(gone)
    if not len(at):
        return None
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])))
    begin, end = at[new], at[np.concatenate((new[1:], [True]))]
    base = np.array(firsts, np.int64)[row[begin]]
    return _span_batch([digests[r] for r in row[begin]], base + inside[begin], base + inside[end] + length)


def _span_batch(digests: list[bytes], begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["digest", "begin", "end"])


SPANS = "digest binary, begin int, end int"


def _subtrees(length: int, most_bytes: int = 8 << 20):
    """Whole groups in memory, many small ones at a time; rows come sorted by prefix."""

    def work(batches):
        held: list[list] = [[] for _ in range(6)]
        for batch in (big.slice(i, 2000) for big in batches for i in range(0, big.num_rows, 2000)):
            for column, values in zip(held, batch.columns):
                column.extend(values.to_pylist())
            if sum(map(len, held[5])) < most_bytes:
                continue
            last = held[0][-1]
            cut = len(held[0])
            while cut and held[0][cut - 1] == last:
                cut -= 1
            if cut:
                out = _repeats_of([c[:cut] for c in held], length)
                held = [c[cut:] for c in held]
                if out is not None:
                    yield out
        if held[0]:
            out = _repeats_of(held, length)
            if out is not None:
                yield out

    return work


WINDOWS = "one long, two long, id long, digest binary, begin int"


def _windows(length: int):
    """Each window of a stretch by two hashes of all its words."""

    def work(batches):
        for big in batches:
            for i in range(0, big.num_rows, 2000):
                batch = big.slice(i, 2000)
                split = [t.split(b" ") for t in batch.column(5).to_pylist()]
                h = _word_hashes(list(chain.from_iterable(split)))
                size = np.fromiter(map(len, split), np.int64, len(split))
                n = batch.column(4).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = inside + np.repeat(np.cumsum(size) - size, n)
                both = []
                for odd in _ODD:
                    total = np.zeros(len(at), np.uint64)
                    for j in range(length):
                        total = (total ^ (total >> np.uint64(31))) * odd + h[at + j]
                    both.append(pa.array(total.view(np.int64)))
                ids, digests = batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row))
                begin = pa.array(batch.column(3).to_numpy()[row] + inside, pa.int32())
                yield pa.RecordBatch.from_arrays([*both, ids, digests, begin], ["one", "two", "id", "digest", "begin"])

    return work


def _cut_out(words: list[bytes], spans: list[dict]) -> list[bytes]:
    kept, done = [], 0
    for s in sorted(spans, key=lambda s: s["begin"]):
        kept += words[done : max(done, s["begin"])]
        done = max(done, s["end"])
    return kept + words[done:]


def _cut_rows(batches):
    for batch in batches:
        kept = [_cut_out(split_words(t), s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        count = pa.array(list(map(len, kept)), pa.int32())
        text = pa.array([b" ".join(k).decode("utf-8", "surrogatepass") for k in kept], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), count, pa.array(map(kept_digest, kept), pa.string()), text], ["digest", "n_kept", "kept", "kept_text"])


def remove_repeats(
    docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", max_group: int = 400_000, with_text: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``; if asked for, with ``kept_text``: the words
    left, joined by a space, or null where nothing goes.

    Texts move once (to meet their repeated anchors), and those with repeats once more, from a scratch table, to meet their spans.
    """
    if length < 2 * GRAM:
        raise ValueError(f"a window has at least {2 * GRAM} words")
    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    held = docs.select(ids.alias("id"), digest.alias("digest"), F.col(text).alias("body"))
    texts = stored(map_batches(held, _read(length), TEXTS), "texts")
    owners = stored(texts.groupBy("digest").agg(F.min("id").alias("id"), F.max("n_words").alias("n_words")), "owners")

    # Anchors of the first holder of each text only; copies are known already.
    thin = texts.where(F.size("hashes") > 0).join(owners.select("digest", "id"), ["digest", "id"], "left_semi")
    each = F.arrays_zip(F.col("hashes").alias("prefix"), F.col("firsts").alias("first"), F.col("lasts").alias("last"))
    suffixes = thin.select("digest", F.explode(each).alias("a")).select("digest", F.col("a.prefix"), F.col("a.first"), F.col("a.last"))
    key = F.xxhash64("digest")
    windows = F.sum(F.col("last") - F.col("first") + 1)
    groups = suffixes.groupBy("prefix").agg(windows.alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    groups = groups.where("low < high").select("prefix", (F.col("n") > max_group).alias("large"))
    groups = stored(groups, "prefixes")  # read anew, so that Spark can split the other side of the join where a prefix is hot
    repeated = suffixes.join(groups, "prefix")
    at = F.collect_set(F.struct("prefix", "first", "last", "large")).alias("at")  # at most the anchors of one text
    wanted = repeated.groupBy("digest").agg(at).join(owners.select("digest", "id"), "digest")
    read = held.join(wanted, ["digest", "id"]).select("id", "digest", "body", "at")
    found = stored(read, "repeated-texts")

    part = lambda large: F.filter("at", lambda a: a["large"] == large)
    some = lambda large: found.select("id", "digest", "body", part(large).alias("at")).where(F.size("at") > 0)
    small = map_batches(some(False), _stretches(length), STRETCHES)
    small = small.repartition("prefix").sortWithinPartitions("prefix")
    spans = map_batches(small, _subtrees(length), SPANS)
    windows = map_batches(map_batches(some(True), _stretches(length), STRETCHES), _windows(length), WINDOWS)
    first = windows.groupBy("one", "two").agg(F.min("id").alias("smallest"))
    gone = windows.join(first, ["one", "two"]).where("id > smallest")
    spans = spans.unionByName(gone.select("digest", "begin", (F.col("begin") + length).alias("end")))
    by_text = spans.groupBy("digest").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # at most the words of one text
    cut = found.select("digest", "body").join(by_text, "digest")
    cut = map_batches(cut.select("digest", "body", "spans"), _cut_rows, "digest binary, n_kept int, kept string, kept_text string")
    cut = (cut if with_text else cut.drop("kept_text")).dropDuplicates(["digest"])

    results = owners.withColumnRenamed("id", "first_id").drop("n_words").join(cut, "digest", "left")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= length)
    own = F.col("n_kept").isNotNull() & (F.col("id") == F.col("first_id"))
    joined = texts.select("id", "digest", "n_words", "whole").join(results, "digest")
    removed = F.when(copy, F.col("n_words")).when(own, F.col("n_words") - F.col("n_kept")).otherwise(0)
    out = joined.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        removed.cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(own, F.col("kept")).otherwise(F.col("whole")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).when(own, F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
    return out
