"""Alignment of two tokenizers by sparse products of token-byte incidence matrices.

For a run of documents, matrix A has a row per token of the first tokenizer and a column per byte of the text, B likewise for the second;
an entry says that the token covers the byte. Both are kept as compressed rows (``Csr``). The product A·Bᵀ, made row by row as Gustavson
does, has an entry for every pair of tokens that overlap, its value the number of bytes they share. Byte offsets where tokens of both
end cut the tokens into groups; the product of the group incidences has an entry for every pair within a group. Documents lie one after
the other in the matrices; both tokenizers end a token where a document ends, so no entry crosses from one to the next.

Corpus-wide counts take two passes over tables of ids. The texts are read and encoded once, in blocks of a few MB; a block row holds its
distinct (A id, B id) pairs and, per document, places in that list. Pairs are summed over blocks before they move, so what is shuffled
grows with the blocks' vocabularies, not with the tokens, and a pair that is in every document costs a row per block. Counts go back to
the blocks by pair, and a task answers the documents of a block.

Nulls: a null or empty text has no tokens, nor has one whose joined token bytes are not a space and the text; its numbers are 0 and its
hash ''. Null ids stay. Repeated rows count as a document each. Very long texts are encoded whole; a block ends after the document that
fills it. Ties for the highest count of an A id all count as best. Columns other than the id and the text are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import map_batches, stored

SLICE_BYTES = 1 << 20  # text in one matrix, unless a single document has more
BLOCK_BYTES = 8 << 20  # text in one block row, unless a single document has more
PRODUCTS = 1 << 20  # entries that a step of a matrix product holds, unless a single row has more
# A run of white space from this length on is encoded by the tokenizers library: the faster encoder cannot follow it.
_LONG_SPACE = re.compile(r"\s{1000}")


# --- sparse matrices ----------------------------------------------------------------------------------------------


def _sums(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


@dataclass(frozen=True)
class Csr:
    """A 0/1 matrix by compressed rows: row ``i`` has the columns ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def runs(cls, lengths: np.ndarray) -> Csr:
        """Rows that cover the columns from left to right: the incidence of tokens and bytes."""
        starts = _sums(lengths)
        return cls(starts, np.arange(starts[-1], dtype=np.int64), int(starts[-1]))

    @classmethod
    def labels(cls, label: np.ndarray, width: int) -> Csr:
        """Rows with one column each: the incidence of tokens and groups."""
        return cls(np.arange(len(label) + 1, dtype=np.int64), label, width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(self.height, dtype=np.int64), self.lengths())
        order = np.argsort(self.columns, kind="stable")
        return Csr(_sums(np.bincount(self.columns, minlength=self.width)), rows[order], self.height)


def row_work(a: Csr, b: Csr) -> np.ndarray:
    """Products that each row of ``a·b`` takes: the symbolic half of the multiplication."""
    return np.diff(_sums(b.lengths()[a.columns])[a.starts])


def multiply(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``a·b`` by rows: for each entry of a row of ``a`` the row of ``b`` it names, summed up by column. Yields the entries of a run of
    rows at a time as rows, columns, values, by row and column."""
    done = _sums(row_work(a, b))
    lengths = b.lengths()
    first = 0
    while first < a.height:
        last = max(first + 1, int(np.searchsorted(done, done[first] + PRODUCTS, "right")) - 1)
        named = a.columns[a.starts[first] : a.starts[last]]
        each = lengths[named]
        total = int(each.sum())
        at = np.repeat(b.starts[named] - (np.cumsum(each) - each), each) + np.arange(total, dtype=np.int64)
        rows = np.repeat(np.arange(first, last, dtype=np.int64), np.diff(done[first : last + 1]))
        keys = rows * b.width + b.columns[at]
        if total:
            if (keys[1:] < keys[:-1]).any():
                keys.sort(kind="stable")
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            distinct = keys[new]
            yield distinct // b.width, distinct % b.width, np.diff(np.append(new, total))
        first = last


# --- the two tokenizers -------------------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library. Special tokens' strings are plain text.

    The vocabulary of the file goes by rank, which tiktoken encodes by several times faster; the tests hold both libraries against each
    other over all of Unicode. Texts with very long white space are left to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters, special = _byte_letters(), {t["id"] for t in said["added_tokens"]}
        vocabulary = said["model"]["vocab"]
        self.pieces = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for piece, i in vocabulary.items():
            if i not in special:
                self.pieces[i] = bytes(letters[c] for c in piece)
        ranks = {piece: i for i, piece in enumerate(self.pieces) if piece}
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.library = path, None

    def ids(self, text: str) -> list[int]:
        text = " " + text
        if not _LONG_SPACE.search(text):
            return self.fast.encode_ordinary(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids


class PieceModel:
    """A sentencepiece model, which puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@dataclass
class Encoder:
    """Both tokenizers and what the matrices need of their vocabularies."""

    a: ByteLevel
    b: PieceModel

    def __post_init__(self):
        self.lengths = [np.array([len(p) for p in t.pieces], np.int64) for t in (self.a, self.b)]
        self.marked = []  # decimal ids with the sign that follows them: within a list, at its end
        for t, end in ((self.a, "|"), (self.b, ";")):
            self.marked.append([np.array([f"{i}{sign}" for i in range(len(t.pieces))], object) for sign in (",", end)])

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of a text by both; none if one of them does not give the text back."""
        if not text:
            return [], []
        out, whole = [], b" " + text.encode()
        for t in (self.a, self.b):
            ids = t.ids(text)
            if b"".join(map(t.pieces.__getitem__, ids)) != whole:
                return [], []
            out.append(ids)
        return out[0], out[1]


@lru_cache(maxsize=2)
def encoder(a_path: str, b_path: str) -> Encoder:
    return Encoder(ByteLevel(a_path), PieceModel(b_path))


# --- a run of documents -------------------------------------------------------------------------------------------


class Aligned:
    """Documents one after the other: ids, groups, and the two products."""

    def __init__(self, both: Encoder, ids: list[tuple[list[int], list[int]]]):
        self.both, self.n_docs = both, len(ids)
        self.counts = [np.array([len(pair[k]) for pair in ids], np.int64) for k in (0, 1)]
        self.ids = [np.array([i for pair in ids for i in pair[k]], np.int64) for k in (0, 1)]
        self.docs = [np.repeat(np.arange(self.n_docs), c) for c in self.counts]
        lengths = [table[i] for table, i in zip(both.lengths, self.ids, strict=True)]
        ends = [np.cumsum(n) for n in lengths]
        self.tokens = [Csr.runs(n) for n in lengths]
        cuts = np.intersect1d(*ends, assume_unique=True)
        self.n_groups = len(cuts)
        self.groups = [np.searchsorted(cuts, e) for e in ends]
        self.in_group = [np.bincount(g, minlength=self.n_groups) for g in self.groups]
        self.group_doc = self.docs[0][_sums(self.in_group[0])[:-1]] if self.n_groups else np.zeros(0, np.int64)

    def overlap(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A token, B token and shared bytes of every overlap: A·Bᵀ."""
        return multiply(self.tokens[0], self.tokens[1].transposed())

    def _by_group(self) -> tuple[Csr, Csr]:
        a, b = (Csr.labels(g, self.n_groups) for g in self.groups)
        return a, b.transposed()

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A and B tokens of one group, all pairs of them."""
        return multiply(*self._by_group())

    def per_doc(self, docs: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Sums (without values: counts) by document."""
        if values is None:
            return np.bincount(docs, minlength=self.n_docs).astype(np.int64)
        out = np.zeros(self.n_docs, np.int64)
        np.add.at(out, docs, values)
        return out

    def group_texts(self) -> list[str]:
        """Per document its groups, ``a1,a2|b1;a3|b2,b3``."""
        before = [_sums(n) for n in self.in_group]
        out = np.empty(len(self.ids[0]) + len(self.ids[1]), object)
        for k, shift in ((0, before[1][:-1]), (1, before[0][1:])):  # a group's A ids come behind the B ids of all groups before
            group, ids = self.groups[k], self.ids[k]
            last = np.ones(len(ids), bool)
            last[:-1] = group[1:] != group[:-1]
            inside, end = self.both.marked[k]
            signed = inside[ids]
            signed[last] = end[ids[last]]
            out[np.arange(len(ids)) + shift[group]] = signed
        ends = np.cumsum(self.counts[0] + self.counts[1]).tolist()
        whole = out.tolist()
        return ["".join(whole[lo:hi])[:-1] for lo, hi in zip([0, *ends], ends, strict=False)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links by document; and the distinct (document, pair of ids) with how often each is linked. A pair is ``a * |B| + b``."""
        n_b = len(self.both.b.pieces)
        span = len(self.both.a.pieces) * n_b
        found, links = [], np.zeros(self.n_docs, np.int64)
        for a, b, _ in self.overlap():
            doc = self.docs[0][a]
            links += self.per_doc(doc)
            found.append(doc * span + self.ids[0][a] * n_b + self.ids[1][b])
        keys, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
        return links, keys // span, keys % span, times


def slices(both: Encoder, texts: Iterator[str | None]) -> Iterator[Aligned]:
    """Texts to matrices of a bounded size; a document is never cut."""
    held, size = [], 0
    for text in texts:
        held.append(both.ids(text))
        size += len(text or "")
        if size >= SLICE_BYTES:
            yield Aligned(both, held)
            held, size = [], 0
    if held:
        yield Aligned(both, held)


# --- links of documents -------------------------------------------------------------------------------------------

LINKS = "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int, bytes: int>>, a_groups array<int>, b_groups array<int>"


def _inputs(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def token_links(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its ids by both tokenizers, the overlap links (places of the tokens, shared bytes), and every token's group."""
    link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(a_path, b_path)
        for batch in batches:
            for r, value in enumerate(batch.column(1)):
                one = Aligned(both, [both.ids(value.as_py())])
                found = [np.concatenate(c).tolist() for c in zip(*one.overlap(), strict=True)] or [[], [], []]
                links = [{"a": a, "b": b, "bytes": n} for a, b, n in zip(*found, strict=True)]
                numbers = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (*one.ids, *one.groups)]
                made = [batch.column(0).slice(r, 1), *numbers[:2], pa.array([links], pa.list_(link)), *numbers[2:]]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "a_ids", "b_ids", "links", "a_groups", "b_groups"])

    return map_batches(_inputs(docs, key, text), work, LINKS)


# --- corpus-wide counts -------------------------------------------------------------------------------------------

NUMBERS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links")
_DOC = pa.struct([*[(c, pa.int64()) for c in NUMBERS], ("groups_sha256", pa.string()), ("at", pa.binary()), ("times", pa.binary())])
BLOCK = (
    "block long, pairs array<long>, n_docs array<int>, docs array<struct<"
    + ", ".join(f"{c}: long" for c in NUMBERS)
    + ", groups_sha256: string, at: binary, times: binary>>"
)


class _Block:
    """Documents gathered for one row."""

    def __init__(self):
        self.size, self.docs, self.doc_of, self.pair, self.times = 0, [], [], [], []

    def add(self, ids: list[int | None], run: Aligned) -> None:
        links, doc, pair, times = run.pairs()
        group_links = run.per_doc(run.docs[0], row_work(*run._by_group()))
        columns = [run.counts[0], run.counts[1], run.per_doc(run.group_doc), links, group_links]
        for numbers in zip(ids, *[c.tolist() for c in columns], run.group_texts(), strict=True):
            *said, text = numbers
            digest = hashlib.sha256(text.encode()).hexdigest() if said[1] else ""
            self.docs.append(dict(zip(NUMBERS, said, strict=True)) | {"groups_sha256": digest})
        self.doc_of.append(doc + (len(self.docs) - run.n_docs))
        self.pair.append(pair)
        self.times.append(times.astype(np.int32))

    def row(self, number: int) -> pa.RecordBatch:
        pairs, at, n_docs = np.unique(np.concatenate(self.pair), return_inverse=True, return_counts=True)
        ends = _sums(np.bincount(np.concatenate(self.doc_of), minlength=len(self.docs)))
        at, times = at.astype(np.int32), np.concatenate(self.times)
        for doc, lo, hi in zip(self.docs, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            doc["at"], doc["times"] = at[lo:hi].tobytes(), times[lo:hi].tobytes()
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        made = [pa.array([number], pa.int64()), one(pairs, pa.int64()), one(n_docs, pa.int32()), one(self.docs, _DOC)]
        return pa.RecordBatch.from_arrays(made, ["block", "pairs", "n_docs", "docs"])


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(a_path, b_path)
        number, now = TaskContext.get().partitionId() << 33, _Block()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            first = 0
            for run in slices(both, (v.as_py() for v in batch.column(1))):
                now.add(ids[first : first + run.n_docs], run)
                first += run.n_docs
                now.size += run.tokens[0].width
                if now.size >= BLOCK_BYTES:
                    yield now.row(number)
                    number, now = number + 1, _Block()
        if now.docs:
            yield now.row(number)

    return map_batches(docs, work, BLOCK)


RESULT = ", ".join(f"{c} long" for c in (*NUMBERS, "n_best", "count_sum")) + ", groups_sha256 string"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the corpus-wide numbers of their pairs to rows per document."""
    for batch in batches:
        for r in range(batch.num_rows):
            stats = batch.column("stats").slice(r, 1).flatten()
            counts, best = (stats.field(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            docs = batch.column("docs").slice(r, 1).flatten()
            n_best, count_sum = [], []
            for at, times in zip(docs.field("at"), docs.field("times"), strict=True):
                at, times = np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(times.as_buffer(), np.int32).astype(np.int64)
                n_best.append(int((times * best[at]).sum()) if len(at) else 0)
                count_sum.append(int((times * counts[at]).sum()) if len(at) else 0)
            made = [*[docs.field(c) for c in NUMBERS], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.field("groups_sha256")]
            yield pa.RecordBatch.from_arrays(made, [*NUMBERS, "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """``pair, n, best``: in how many documents a pair of ids is linked, and whether no pair of its A id is in more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n"))
    summed = each.groupBy("pair").agg(F.sum("n").alias("n"))
    # a group of this window has at most as many rows as the second vocabulary has ids
    of_a = Window.partitionBy("a")
    return summed.withColumn("a", F.expr(f"pair div {n_b}")).select("pair", "n", (F.max("n").over(of_a) == F.col("n")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: tokens, groups, overlap links and shared-group links, and its links by their corpus-wide counts."""
    blocks = stored(_blocks(_inputs(docs, key, text), a_path, b_path), "aligned-blocks", "zstd")
    counts = stored(pair_counts(blocks, len(PieceModel(b_path).pieces)), "pair-counts")
    asked = blocks.select("block", F.posexplode("pairs").alias("pos", "pair")).join(counts, "pair")
    stats = asked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "best"))).alias("stats"))
    none = F.array().cast("array<struct<pos: int, n: bigint, best: boolean>>")
    answered = blocks.select("block", "docs").join(stats, "block", "left").select("docs", F.coalesce("stats", none).alias("stats"))
    return map_batches(answered, _answer, RESULT)
