import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textquarry.llm import token_files as tf
from textquarry.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(rows):
    """``doc_id -> (start, n, crc, ids)`` by the library alone, whole text by whole text."""
    tokenizer = Tokenizer.from_file(PATH)
    start, out = 0, []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_query_equals_the_library(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in QUERIES["op10_token_files"](spark, sf).collect())
    assert got == [r[:4] for r in plain([(r.doc_id, r.text) for r in docs])]


def test_odd_texts_round_trip(spark, make, tmp_path):
    texts = [
        None, "", "  \n\t", "Ein  Satz\x0bmit\x0c\rvielem", "é ́ x y z \x1c \x85 q", "it's WE'LL <|endoftext|>x <|startoftext|>",
        "İΣ ΣΑΣ straße 12345 \U0001f600‍️", "Wort " * 90_000, "한 ᄒ ᅡ",
    ]
    rows = list(enumerate(texts))
    docs = make(rows).selectExpr("*", "1 as ids", "2 as tag", "'x' as part")
    tf.write_token_files(docs, str(tmp_path / "a"), PATH, block_tokens=50)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in tf.read_token_files(spark, str(tmp_path / "a"), True).collect())
    assert got == plain(rows)


def test_words_that_are_empty_or_signs_alone():
    with open(PATH, encoding="utf-8") as f:
        memo = tf.WordIds(f.read(), memo_words=1000)
    texts = [" lead", "", "trail ", "...", "a... b?!", "x.", None]
    ids, n = memo.encode(pa.array(texts))
    want = [i for r in plain(list(enumerate(texts))) for i in r[4]]
    assert ids.tolist() == want and len(n) == len(texts)
    part = pa.array([b"xy", b"ab", b"", b"cdef"], pa.binary()).slice(1)
    assert tf._values(part).tobytes() == b"abcdef"


def test_null_and_repeated_ids_and_empty_tables(spark, make, tmp_path):
    rows = [(None, "b"), (5, "a b c"), (5, "a b c"), (5, "z"), (None, None), (2, "q")]
    tf.write_token_files(make(rows), str(tmp_path / "b"), PATH)
    got = sorted(tf.read_token_files(spark, str(tmp_path / "b"), True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 2, 5, 5, 5]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    tf.write_token_files(make(rows).limit(0), str(tmp_path / "c"), PATH)
    assert tf.read_token_files(spark, str(tmp_path / "c")).collect() == []


def kraft(bits):
    return sum(2.0**-b for b in bits)


@pytest.mark.parametrize("n", [1, 2, 3, 40, 700, 5000])
def test_lengths_are_limited_and_complete(n):
    counts = np.random.default_rng(n).zipf(1.3, n).clip(1, 1 << 40)
    bits = tf.code_lengths(counts)
    assert bits.max() <= tf.MAX_BITS and (n == 1 or kraft(bits) == 1.0)
    order = np.argsort(counts, kind="stable")
    assert (np.diff(bits[order]) <= 0).all()


def test_lengths_are_optimal_where_the_limit_does_not_bind():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 45, 1])
    heap, cost = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((tf.code_lengths(counts) * counts).sum()) == cost


def test_more_ids_than_codes_are_refused():
    with pytest.raises(ValueError):
        tf.code_lengths(np.ones(5, np.int64), max_bits=2)


@pytest.mark.parametrize("n", [1, 255, 256, 257, 70_000])
def test_blocks_decode_alone(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.2, n).clip(1, 40_000).astype(np.uint32)
    used, counts = np.unique(ids, return_counts=True)
    book = tf.Codebook(used.astype(np.int64), tf.code_lengths(counts))
    cut = np.array([n] if n < 3 else [1, n // 2, n - 1 - n // 2])
    payloads, points = tf.pack(ids, cut, *book.encoder())
    table, bits = book.decoder()
    assert [len(p) for p in points] == (-(-cut // tf.CHECKPOINT)).tolist()
    for payload, point, size, end in zip(payloads, points, cut, np.cumsum(cut)):
        got = tf.unpack([payload], np.array([0]), np.array([size]), point, table, bits, book.width)
        assert (got == ids[end - size : end]).all()
    all_points = np.concatenate(points)
    got = tf.unpack(payloads, np.arange(len(cut)), cut, all_points, table, bits, book.width)
    assert (got == ids).all()


def test_memo_forgets_and_stays_right():
    with open(PATH, encoding="utf-8") as f:
        memo = tf.WordIds(f.read(), memo_words=40)
    tokenizer = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(2)
    letters = list("abcdefgé'.,!1-İ|$\u0958\u0301")
    for _ in range(30):
        texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 6))) for _ in range(20)) for _ in range(4)]
        ids, n = memo.encode(pa.array(texts))
        want = [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids + [1]]
        assert ids.tolist() == want and int(n.sum()) == len(want)
    assert len(memo.known) < 400


def test_slices_are_encoded_like_whole_arrays():
    with open(PATH, encoding="utf-8") as f:
        memo = tf.WordIds(f.read(), memo_words=1000)
    texts = pa.array(["Ein Satz", None, "zwei été Sätze", "", "Drei"])
    for whole in (texts, texts.cast(pa.large_string())):
        got = [memo.encode(whole.slice(i, 1))[0].tolist() for i in range(5)]
        assert sum(got, []) == memo.encode(whole)[0].tolist()


def test_latin_words_are_not_folded_and_searched_by_the_library():
    with open(PATH, encoding="utf-8") as f:
        memo = tf.WordIds(f.read(), memo_words=1000)
    texts = ["Ein Satz, Été: ÇA", None, "señor über ŒUVRE", "plain Words"]
    want = [i for r in plain(list(enumerate(texts))) for i in r[4]]
    memo.encode(pa.array([", . :"]))
    memo.tokenizer = None  # not needed for words of letters, nor for the signs seen before
    assert memo.encode(pa.array(texts))[0].tolist() == want


def test_every_letter_and_sign_of_the_latin_blocks():
    with open(PATH, encoding="utf-8") as f:
        memo = tf.WordIds(f.read(), memo_words=5000)
    others = [0x3A3, 0x3C2, 0x410, 0x958, 0x1E9E, 0x4E00, 0xAC00, 0x1112, 0x1161]
    for first in range(1, 0x300, 0x40):
        chars = [chr(c) for c in [*range(first, first + 0x40), *others]]
        texts = [t for c in chars for t in (c, c + ".", f"a{c}b!? x", f".{c}", f"é.{c} {c}É...\u0301 ...", f"A{c}S <|endoftext|>.")]
        texts += ["", None, "."]
        want = [i for r in plain(list(enumerate(texts))) for i in r[4]]
        assert memo.encode(pa.array(texts))[0].tolist() == want
        assert memo.encode(pa.array([None, *texts]).slice(1))[0].tolist() == want


def test_words_are_cut_at_white_space_and_before_signs():
    words, before = tf.cut_words(pa.array(["x", "A b.  É?!\tİ. ", None, "", "... c.d. 1,", ".", "e"]).slice(1))
    assert words.to_pylist() == ["a", "b", ".", "É", "?!", "İ.", "...", "c.d", ".", "1", ",", ".", "e"]
    assert before.tolist() == [0, 6, 6, 6, 11, 12, 13]
