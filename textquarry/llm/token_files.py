"""Token files: ids of a public tokenizer in canonical, length-limited Huffman code, in blocks that decode alone.

Layout below a folder, all written and read by Spark's Parquet files, so any file system that Spark reaches will do:

* ``codes``: ``id, bits``, the code length of every id in use. Codes are canonical: ascending by (bits, id).
* ``blocks``: one row per block of whole documents: ``part, inside, n_tokens, doc_ids, doc_tokens, checkpoints, payload``. ``inside``
  counts the ids before the block in its file; ``payload`` holds the codes, most significant bit first, each document from a full
  byte on; ``checkpoints`` the bit offset of every ``CHECKPOINT``-th id of a document, from each of which a reader can start. Files follow each other by ``part``, blocks by ``inside``, in ascending order of document id.
* ``parts``: ``part, start``: ids in all files before.

Documents are tokenized once, into a scratch table of id bytes; ids are counted on the way (one list per task moves), code
lengths come from the global counts by package merging on the driver (its size is the vocabulary's), and the coded documents are
range partitioned by document id and put together to blocks. Whitespace never survives this tokenizer, so a text's ids are those of its words one after
the other: each task has the library encode a word when it first meets it (see ``WordIds``).

Nulls: a null text has the end id alone; null document ids come first. Rows that repeat an id follow each other, by text hash. An
empty table gives no blocks. A document is never cut, so a block is as long as its last document makes it.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_right
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textquarry.llm.common import map_batches, stored
from textquarry.session import apply_defaults

END_ID = 1
CHECKPOINT = 256
BLOCK_TOKENS = 1 << 16
MAX_BITS = 16
BLOCK_SCHEMA = (
    "part int, inside long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, checkpoints array<int>, payload binary"
)


# Signs at the end of a word that this tokenizer splits off as one piece (an apostrophe may open a contraction).
TAIL = b".,;:!?*#$%&|"
# Letters of Latin blocks, composed, that fold to one letter each; so a word of them is one piece. Behind ASCII, those of
# the first bytes C3 to C9 in UTF-8 without the signs of times and division and the dotted capital I, whose small form has two characters.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u027f"
NO_LETTERS = ("\u00d7", "\u00f7", "\u0130")
SPACE = b" \t\n\v\f\r"
_KINDS = bytes(1 if b in SPACE else 2 if b in TAIL else 0 for b in range(256))
_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])


def _after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter or digit of ASCII, or a letter of ``LATIN``, ends before the places ``at``, all above 0."""
    last, lead = data[at - 1], data[np.maximum(at - 2, 0)]
    latin = (last >= 0x80) & (last < 0xC0) & (lead >= 0xC3) & (lead <= 0xC9)
    for sign in NO_LETTERS:
        first, second = sign.encode()
        latin &= (lead != first) | (last != second)
    return _ALNUM[last] | latin


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null: none), in lower case as to ASCII, and how many words come before each text and in all. Signs behind
    a letter or digit at the end of a word are a word of their own: a space there changes no id."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(plain):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    bound = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    raw = (plain.buffers()[2] or pa.py_buffer(b""))[int(bound[0]) : int(bound[-1])].to_pybytes()
    bound = bound - bound[0]
    if b"<|" not in raw:  # special tokens are found before the tokenizer folds its input
        raw = raw.lower()
    data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_KINDS) + b"\x01", np.uint8)
    filled, edge = kind[:-1] != 1, np.zeros(len(kind), bool)
    edge[bound] = True  # a text begins or ends
    begins = filled.copy()
    begins[1:] &= (kind[:-2] == 1) | edge[1:-1]
    # Runs of signs that end a word, with a letter or digit of the same word before them.
    step = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])) | edge)
    run = np.flatnonzero(kind[step] == 2)
    first, last = step[run], step[run + 1]
    first = first[(edge[last] | (kind[last] == 1)) & ~edge[first]]
    begins[first[_after_letter(data, first)]] = True
    before = np.searchsorted(np.flatnonzero(begins), bound)
    packed = raw.translate(None, SPACE)
    small = len(packed) < 1 << 31
    offsets = np.append(np.flatnonzero(begins[filled]), len(packed)).astype(np.int32 if small else np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
    words = pa.Array.from_buffers(pa.string() if small else pa.large_string(), len(offsets) - 1, buffers)
    return words, before


def _ends_in_letter(stem: bytes) -> bool:
    """Whether what follows is split off for sure: the last character is a letter or digit, also composed and in lower case."""
    if stem[-1] < 0x80:
        return stem[-1:].isalnum()
    return unicodedata.normalize("NFC", stem.decode("utf-8")).lower()[-1].isalnum()


def _one_piece(word: bytes) -> bool:
    """Whether a word with other than ASCII letters is letters only to the tokenizer."""
    if word.isascii():
        return False
    text = word.decode("utf-8")
    return text.isalpha() and text.lower().isalpha() and unicodedata.is_normalized("NFC", text)


class WordIds:
    """Ids of texts by their words. The library encodes what it has not seen yet: the stem of a word, and the signs behind it.

    Words that one piece holds (letters in composed form) are encoded many to a string and cut apart behind the ids that end a word,
    Latin ones without the file's folding and searching, which leave them as they are; any other word is encoded by itself.
    At most about ``memo_words`` words are kept, those met again before the others.
    """

    def __init__(self, tokenizer_json: str, memo_words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.latin = Tokenizer.from_str(tokenizer_json)
        self.latin.normalizer = normalizers.Sequence([])
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.counts = np.zeros(len(self.ends), np.int64)  # of all ids given out; whoever reads them sets them back
        self.memo_words = memo_words
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(0, np.uint32), 0
        self.begin = self.length = self.met = np.zeros(0, np.int32)

    def forget(self) -> None:
        """Keep the words met most often since the last time, at most half of the memo."""
        keep = np.flatnonzero(self.met[: len(self.known)] > 1)
        if len(keep) > self.memo_words // 2:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[: self.memo_words // 2]])
        names = list(self.known)
        ids, length = self._ids_of(keep), self.length[keep]
        self.known = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.ids, self.used, self.length = ids, len(ids), length
        self.begin = (np.cumsum(length, dtype=np.int64) - length).astype(np.int32)
        self.met = np.zeros(len(keep), np.int32)

    def _ids_of(self, at: np.ndarray) -> np.ndarray:
        length = self.length[at]
        done = np.cumsum(length, dtype=np.int64)
        place = np.repeat((self.begin[at] - done + length).astype(np.int32), length)
        place += np.arange(len(place), dtype=np.int32)
        return self.ids[place]

    def _add(self, words: list[bytes], parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``parts``: ids and lengths of the words, some words each."""
        ids, length = np.concatenate([i for i, _ in parts]), np.concatenate([n for _, n in parts])
        n, end = len(self.known), len(self.known) + len(words)
        while end > len(self.length):  # room for as many again: adding costs no copy most of the time
            self.begin, self.length, self.met = (np.concatenate((a, np.zeros(len(a) + 1024, a.dtype))) for a in (self.begin, self.length, self.met))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids) + 4096, self.ids.dtype)))
        self.begin[n:end], self.length[n:end], self.met[n:end] = self.used + np.cumsum(length) - length, length, 0
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(words, range(n, end)))

    def _pieces_of(self, texts: list[str], tokenizer) -> np.ndarray:
        coded = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(coded), np.uint32, sum(map(len, coded)))

    def _lengths(self, ids: np.ndarray, words: int) -> np.ndarray | None:
        """How many ids each word has, if the ids have as many ends of words as they should."""
        ends = np.flatnonzero(self.ends[ids])
        return np.diff(np.concatenate(([-1], ends))) if len(ends) == words else None

    def _encode_pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._pieces_of([b" ".join(words).decode("utf-8")], self.tokenizer)
        length = self._lengths(ids, len(words))
        return (ids, length) if length is not None else self._encode_each(words)

    def learn_latin(self, words: pa.Array, names: list[bytes], per_string: int = 200) -> None:
        """Add words of ``LATIN`` letters not known yet; ``names``: the same. The library need not compose or search them: spaces cut
        them, and as each letter folds to one, ``str.lower`` folds them."""
        cuts = pa.array([*range(0, len(words), per_string), len(words)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(cuts, words.cast(pa.string())), " ").to_pylist()
        ids = self._pieces_of([t.lower() for t in texts], self.latin)
        length = self._lengths(ids, len(words))
        self._add(names, [(ids, length) if length is not None else self._encode_each(names)])

    def _encode_each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch([w.decode("utf-8") for w in words], add_special_tokens=False)]
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(length.sum())), length

    def learn(self, words: list[bytes], per_string: int = 1000) -> None:
        """Add words not known yet."""
        stems, tails, marked = [], [], set()
        for word in words:
            if word[-1:] in TAIL:  # also of an empty word, whose stem is empty
                stem = word.rstrip(TAIL)
                if stem and _ends_in_letter(stem):
                    stems.append(stem)
                    tails.append(word[len(stem) :])
                    marked.add(word)
        new = words if not stems else {*marked.symmetric_difference(words), *stems, *tails}.difference(self.known)
        pieces, others = [], []
        for word in new:  # of bytes: ASCII letters
            (pieces if word.isalpha() or _one_piece(word) else others).append(word)
        parts = [self._encode_pieces(pieces[i : i + per_string]) for i in range(0, len(pieces), per_string)]
        if others:
            parts.append(self._encode_each(others))
        if parts:
            self._add(pieces + others, parts)
        if stems:
            number = self.known.__getitem__
            pair = np.array([list(map(number, stems)), list(map(number, tails))], np.int64).T
            joined = [a + b for a, b in zip(stems, tails)]
            self._add(joined, [(self._ids_of(pair.ravel()), self.length[pair].sum(axis=1, dtype=np.int64))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id behind each, and how many each has. Numpy cuts the texts to words and Arrow finds the different
        ones, so Python sees each word once per batch."""
        cut, before = cut_words(texts)
        coded = cut.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.memo_words:
            self.forget()
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            unknown, names = coded.dictionary.take(pa.array(new)), [words[i] for i in new.tolist()]
            latin = pc.match_substring_regex(unknown, f"^[{LATIN}]+$")
            chosen = latin.to_numpy(zero_copy_only=False)
            if chosen.any():
                self.learn_latin(unknown.filter(latin), list(compress(names, chosen.tolist())))
            self.learn(list(compress(names, (~chosen).tolist())))
            number[new] = np.fromiter(map(self.known.__getitem__, names), np.int32, len(names))
        at = number[coded.indices.to_numpy()]
        seen = np.bincount(coded.indices.to_numpy(), minlength=len(words))
        self.met[number] += seen
        of = np.bincount(self._ids_of(number), np.repeat(seen, self.length[number]), minlength=len(self.ends))
        self.counts += of.astype(np.int64)
        self.counts[END_ID] += len(texts)
        # The end ids are put in by position: after each text's words.
        done = np.concatenate(([0], np.cumsum(self.length[at], dtype=np.int64)))
        ends = done[before[1:]]
        return np.insert(self._ids_of(at), ends, END_ID), np.diff(np.concatenate(([0], ends))) + 1


def _values(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls, one value after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def id_type(tokenizer_json: str) -> str:
    """Numpy's name of the least little-endian type that holds every id of a tokenizer (and the end id)."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_str(tokenizer_json).get_vocab().values(), default=0) < 1 << 16 else "<u4"


_TOKENIZERS: dict[int, WordIds] = {}


def tokenized(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", memo_words: int = 200_000) -> DataFrame:
    """``doc_id, tag, n_tokens, ids`` (little-endian ids, see ``id_type``) of every document; the tokenizer's file is read here.

    Every task ends with a row that is no document: ``counts`` has how often it gave out each id."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = id_type(sent.value)
    width = int(kind[-1])

    def work(batches):
        key = zlib.crc32(sent.value.encode())
        if key not in _TOKENIZERS:  # kept by a reused worker
            _TOKENIZERS[key] = WordIds(sent.value, memo_words)
        words = _TOKENIZERS[key]
        words.counts[:] = 0
        names = ["doc_id", "tag", "n_tokens", "ids", "counts"]
        for whole in batches:
            rows = max(1, whole.num_rows * (3 << 20) // max(whole.nbytes, 3 << 20))
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                ids, n = words.encode(batch.column(1))
                ends = np.concatenate(([0], np.cumsum(n) * width))
                raw = ids.astype(kind).tobytes()
                packed = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
                none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), packed, none], names)
                pa.default_memory_pool().release_unused()
        last = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary()), pa.array([words.counts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(last, names)

    key = F.col(doc_id).cast("long")
    held = docs.select(key.alias("doc_id"), F.col(text).alias("body"), F.xxhash64(key, F.col(text)).alias("tag"))
    return map_batches(held, work, "doc_id long, tag long, n_tokens long, ids binary, counts array<long>")


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id, n`` over all documents, from the sums of the tasks."""
    each = tokens.where(F.col("counts").isNotNull()).select(F.posexplode("counts").alias("id", "n")).where("n > 0")
    return each.groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive ``counts``, by package merging."""
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need codes of more than {max_bits} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    leaf_flags, level = [], leaves
    leaf_flags.append(np.ones(n, bool))
    for _ in range(max_bits - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, packages))
        place = np.argsort(both, kind="stable")
        level = both[place]
        leaf_flags.append(place < n)
    lengths, chosen = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(leaf_flags):
        taken = int(flags[:chosen].sum())
        lengths[:taken] += 1
        chosen = 2 * (chosen - taken)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes of ids by length, and the table that decodes any window of ``width`` bits in one look."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.uint32), bits[order].astype(np.int64)
        self.width = int(self.bits.max()) if len(ids) else 1
        step = np.int64(1) << (self.width - self.bits)
        self.first = np.cumsum(step) - step  # left-aligned codes
        self.codes = self.first >> (self.width - self.bits)
        self.size = int(self.ids.max()) + 1 if len(ids) else 0

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        codes, bits = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int64)
        codes[self.ids], bits[self.ids] = self.codes.astype(np.uint64), self.bits
        return codes, bits

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length for every window. A lone id of one bit fills half the table; the rest repeats it."""
        span = np.int64(1) << (self.width - self.bits)
        at = np.repeat(np.arange(len(self.ids)), span)
        at = np.concatenate((at, np.full((1 << self.width) - len(at), len(self.ids) - 1)))
        return self.ids[at], self.bits[at]


def pack(ids: np.ndarray, n_tokens: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Payload and checkpoints of some documents, each of at least one id. All are laid out in one row of 32-bit words, every
    document from a full byte on. A code falls in at most two words and no bit is set twice, so sums over the codes that start in a
    word write it; code and gap are shorter than a word together, so no word is passed over."""
    length = bits[ids]
    done = np.concatenate(([0], np.cumsum(length)))
    last = np.cumsum(n_tokens)
    size = -(-(done[last] - done[last - n_tokens]) // 8)  # bytes of each document
    begin = np.cumsum(size) - size
    at = done[:-1] + np.repeat(begin * 8 - done[last - n_tokens], n_tokens)
    word, shift = at >> 5, (64 - (at & 31) - length).astype(np.uint64)
    value = codes[ids] << shift
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[:-1] = np.add.reduceat(value >> np.uint64(32), first)
    out[1:] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    raw = out.astype(">u4").tobytes()
    payloads = [raw[a : a + n] for a, n in zip(begin.tolist(), size.tolist())]
    points = [
        (at[a : a + n : CHECKPOINT] - 8 * b).astype(np.int32) for a, n, b in zip((last - n_tokens).tolist(), n_tokens.tolist(), begin.tolist())
    ]
    return payloads, points


def unpack(
    payloads: list[bytes], block: np.ndarray, n_tokens: np.ndarray, checkpoints: np.ndarray, ids: np.ndarray, bits: np.ndarray, width: int
) -> np.ndarray:
    """Ids of the documents of some blocks. Every checkpoint is a lane; all lanes decode one id per step, each by one table look.
    ``block``: that of each document; ``n_tokens``: of each document; ``checkpoints``: of all, as bits of their block."""
    size = np.fromiter(map(len, payloads), np.int64, len(payloads)) + 4
    data = np.frombuffer(b"".join(p + b"\0\0\0\0" for p in payloads), np.uint8)
    base = (np.cumsum(size) - size) * 8
    lanes = -(-n_tokens // CHECKPOINT)
    at = checkpoints.astype(np.int64) + np.repeat(base[block], lanes)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    left = np.minimum(CHECKPOINT, np.repeat(n_tokens, lanes) - nth * CHECKPOINT)
    begin = np.repeat(np.cumsum(n_tokens) - n_tokens, lanes) + nth * CHECKPOINT
    out = np.empty(int(n_tokens.sum()), np.uint32)
    order = np.argsort(-left, kind="stable")  # short lanes last: those still running are a prefix
    at, left, begin = at[order], left[order], begin[order]
    mask = (1 << width) - 1
    for step in range(CHECKPOINT):
        live = int(np.searchsorted(-left, -step, side="left"))
        if not live:
            break
        p = at[:live]
        byte = p >> 3
        window = (data[byte].astype(np.int64) << 16) | (data[byte + 1].astype(np.int64) << 8) | data[byte + 2]
        window = (window >> (24 - width - (p & 7))) & mask
        out[begin[:live] + step] = ids[window]
        at[:live] = p + bits[window]
    return out


def _order(doc_id: int | None, tag: int, row: int) -> tuple:
    """The order of documents: null ids first; the row number only spreads equal rows over files."""
    return (doc_id is not None, doc_id or 0, tag, row)


def _file_bounds(keys: DataFrame, files: int, per_file: int = 10, least: int = 10_000) -> list[tuple]:
    """Where every file but the first begins, from a sample of about ``per_file`` keys per file, ``least`` at least: files get
    about equal numbers of documents. The sample only balances; any bounds give right files. Thin keys are sampled here, and not by a range
    partitioning, which would code all documents to look at their keys."""
    share = min(1.0, max(files * per_file, least) / max(keys.count(), 1))
    sample = sorted(_order(*r) for r in keys.sample(share, seed=1).collect())
    return [sample[len(sample) * i // files] for i in range(1, files)] if sample else []


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tokens_per_file: int = 1 << 27,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    spark = apply_defaults(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        kind = id_type(f.read())
    tokens = stored(tokenized(docs, tokenizer_path, doc_id, text), "tokens", compression="zstd")
    counted = id_counts(tokens).toPandas().sort_values("id")  # at most the vocabulary
    ids, total = counted["id"].to_numpy(np.int64), int(counted["n"].sum())
    lengths = code_lengths(counted["n"].to_numpy(np.int64))
    table = [(int(i), int(b)) for i, b in zip(ids, lengths)]
    spark.createDataFrame(table, "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    sent = spark.sparkContext.broadcast((ids, lengths))

    # As many files as the ids ask for; small inputs use the cores there are.
    cores = spark.sparkContext.defaultParallelism
    files = max(-(-total // tokens_per_file), min(cores, -(-total // (1 << 20))), 1)
    numbered = tokens.where(F.col("n_tokens").isNotNull()).select("doc_id", "tag", F.monotonically_increasing_id().alias("row"), "n_tokens", "ids")
    bounds = spark.sparkContext.broadcast(_file_bounds(numbered.select("doc_id", "tag", "row"), files))

    def coded(batches):
        codes, bits = Codebook(*sent.value).encoder()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                flat = _values(batch.column(4)).view(kind)
                payloads, points = pack(flat, batch.column(3).to_numpy(), codes, bits)
                keys = zip(*(c.to_pylist() for c in batch.columns[:3]))
                file = pa.array([bisect_right(bounds.value, _order(*k)) for k in keys], pa.int32())
                added = [pa.array(payloads, pa.binary()), pa.array(points, pa.list_(pa.int32())), file]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *added], ["doc_id", "tag", "row", "n_tokens", "payload", "points", "file"])

    def blocked(batches):
        part, before = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        tokens_held = 0

        def block():
            offset = np.cumsum([0] + [len(h[2]) for h in held[:-1]]) * 8
            points = np.concatenate([np.asarray(h[3]) + o for h, o in zip(held, offset)])
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "inside": pa.array([before], pa.int64()), "n_tokens": pa.array([tokens_held], pa.int64()),
                    "doc_ids": pa.array([[h[0] for h in held]], pa.list_(pa.int64())), "doc_tokens": pa.array([[h[1] for h in held]], pa.list_(pa.int32())),
                    "checkpoints": pa.array([points], pa.list_(pa.int32())), "payload": pa.array([b"".join(h[2] for h in held)], pa.binary()),
                }
            )

        for batch in batches:
            for doc, n, value, points in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                held.append((doc, n, value.as_py(), points.values))
                tokens_held += n
                if tokens_held >= block_tokens:
                    yield block()
                    held, tokens_held, before = [], 0, before + tokens_held
        if held:
            yield block()

    schema = "doc_id long, tag long, row long, n_tokens long, payload binary, points array<int>, file int"
    dealt = numbered.mapInArrow(coded, schema).repartitionById(files, F.col("file")).sortWithinPartitions("doc_id", "tag", "row")
    dealt = dealt.select("doc_id", "n_tokens", "payload", "points")
    dealt.mapInArrow(blocked, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts.select("part", before.alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files; with its ``ids`` if asked for."""
    apply_defaults(spark)
    table = spark.read.schema("id long, bits int").parquet(f"{path}/codes").toPandas().sort_values("id")
    sent = spark.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["bits"].to_numpy(np.int64)))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # One row of two numbers per file; the files are what write_token_files counted out.
    parts = F.broadcast(spark.read.schema("part int, start long").parquet(f"{path}/parts"))
    rows = blocks.join(parts, "part").withColumn("start", F.col("start") + F.col("inside"))
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
        + ([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])
    )

    def work(batches):
        book = Codebook(*sent.value)
        ids, bits = book.decoder()
        for batch in batches:
            for i in range(0, batch.num_rows, 16):  # some blocks at a time
                n, start, docs, sizes, points, payload = (batch.column(c).slice(i, 16) for c in range(6))
                counts = n.to_numpy()
                each = np.concatenate([np.asarray(s.values) for s in sizes]).astype(np.int64)
                block = np.repeat(np.arange(len(counts)), [len(s.values) for s in sizes])
                lanes = np.concatenate([np.asarray(p.values) for p in points])
                flat = unpack(payload.to_pylist(), block, each, lanes, ids, bits, book.width)
                ends = np.cumsum(each)
                raw = flat.astype("<u4")
                crc = [zlib.crc32(raw[b - s : b]) for b, s in zip(ends.tolist(), each.tolist())]
                first = ends - each - (np.cumsum(counts) - counts)[block] + start.to_numpy()[block]
                out = [pa.concat_arrays([d.values for d in docs]), pa.array(first), pa.array(each), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array([raw[b - s : b].astype(np.int64) for b, s in zip(ends.tolist(), each.tolist())], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.select("n_tokens", "start", "doc_ids", "doc_tokens", "checkpoints", "payload").mapInArrow(work, schema)
