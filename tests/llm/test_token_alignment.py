import hashlib
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from textquarry.llm import token_alignment
from textquarry.llm.queries import QUERIES
from textquarry.llm.token_alignment import ByteLevel, Csr, align, encoder, multiply, token_links

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def printable(b):
    return 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b


UNIT = {chr(b): b for b in range(256) if printable(b)}
UNIT |= {chr(256 + k): b for k, b in enumerate([b for b in range(256) if not printable(b)])}


@pytest.fixture(scope="module")
def plain_tokens():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    def both(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        one = [(i, bytes(UNIT[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            two.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        if any(b"".join(t[1] for t in side) != whole for side in (one, two)):
            return [], []
        return one, two

    return both


def spans(tokens):
    at = 0
    for i, piece in tokens:
        yield i, at, at + len(piece)
        at += len(piece)


def plain(rows, plain_tokens):
    """By definition: every pair of tokens compared, every count by a dictionary."""
    docs = []
    for doc_id, text in rows:
        a, b = (list(spans(side)) for side in plain_tokens(text))
        links, j0 = [], 0
        for i, lo, hi in a:
            while j0 < len(b) and b[j0][2] <= lo:
                j0 += 1
            j = j0
            while j < len(b) and b[j][1] < hi:
                links.append((i, b[j][0]))
                j += 1
        cuts = sorted({t[2] for t in a} & {t[2] for t in b})
        groups, lo = [], 0
        for cut in cuts:
            groups.append(tuple([t[0] for t in side if lo <= t[1] < cut] for side in (a, b)))
            lo = cut
        docs.append((doc_id, len(a), len(b), groups, links))
    count = Counter(p for d in docs for p in set(d[4]))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if n_a else ""
        best = sum(count[p] == most[p[0]] for p in links)
        pairs = sum(len(x) * len(y) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), pairs, best, sum(count[p] for p in links), digest))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_best", "count_sum", "groups_sha256"]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


TEXTS = [
    None, "", " ", "a", "  two  spaces\n\n\ttab ", "Grüße, naïve café — ﬁn 日本語 😀👩‍👩‍👧 ́e", "<|endoftext|> </s> <s> <unk> <0x41>", "a\x00b\x7f▁c", "▁▁x",
    "words " * 3000, "words " * 3000, " " * 5000 + "x" + "\n" * 3000, "x" * 5000, "ǅ‍﻿　  ß", "12345678901234567890 3.14", "１２３ 𝟘𝟙 ݐ",
]


def test_odd_texts_agree_with_brute_force(make, plain_tokens):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "a"), (3, "other")]
    docs = make(rows).selectExpr("*", "1 AS block", "2 AS pairs", "3 AS docs", "4 AS n_a")
    assert order(align(docs, A, B).select(*COLUMNS).collect()) == order(plain(rows, plain_tokens))
    assert align(docs.limit(0), A, B).collect() == []


def test_query_agrees_with_brute_force_over_several_blocks(spark, sf, plain_tokens, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    wanted = order(plain(rows, plain_tokens))
    assert order(QUERIES["op13_token_alignment"](spark, sf).select(*COLUMNS).collect()) == wanted
    small = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    assert order(align(small, A, B).select(*COLUMNS).collect()) == wanted


def test_links_and_groups_of_a_text(make, plain_tokens):
    text = "Grüße aus 日本 😀 and more"
    row = token_links(make([(1, text), (2, None)]), A, B).orderBy("doc_id").collect()
    a, b = (list(spans(side)) for side in plain_tokens(text))
    assert row[0].a_ids == [t[0] for t in a] and row[0].b_ids == [t[0] for t in b]
    shared = [(i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b)]
    assert [tuple(x) for x in row[0].links] == [s for s in shared if s[2] > 0]
    cuts = sorted({t[2] for t in a} & {t[2] for t in b})
    assert row[0].a_groups == [sum(c < t[2] for c in cuts) for t in a] and row[0].b_groups == [sum(c < t[2] for c in cuts) for t in b]
    assert (row[1].a_ids, row[1].links) == ([], [])


def test_products_agree_with_dense_ones(monkeypatch):
    rng = np.random.default_rng(3)
    for bound in (5, 1 << 20):
        monkeypatch.setattr(token_alignment, "PRODUCTS", bound)
        for _ in range(20):
            n, m, k = rng.integers(1, 12, 3)
            x, y = rng.random((n, m)) < 0.4, rng.random((m, k)) < 0.4
            made = []
            for d in (x, y):
                made.append(Csr(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1].astype(np.int64), d.shape[1]))
            out = np.zeros((n, k), int)
            for r, c, v in multiply(*made):
                out[r, c] += v
            assert (out == x.astype(int) @ y.astype(int)).all()
            back = made[0].transposed().transposed()
            assert (back.starts == made[0].starts).all() and (back.columns == made[0].columns).all()


def test_group_product_has_all_pairs_of_a_group():
    both = encoder(A, B)
    run = token_alignment.Aligned(both, [both.ids("日本語 text"), both.ids(""), both.ids("more 😀")])
    found = {(int(i), int(j)) for r, c, _ in run.shared_groups() for i, j in zip(r, c, strict=True)}
    assert found == {(i, j) for i, g in enumerate(run.groups[0]) for j, h in enumerate(run.groups[1]) if g == h}


def test_fast_ids_are_those_of_the_library_over_all_of_unicode():
    """Every assigned code point beside letters, digits, spaces and itself."""
    library, mine = Tokenizer.from_file(A), ByteLevel(A)
    library.encode_special_tokens = True
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co") and not 0x3400 <= c < 0xD7A4 and c < 0x17000]
    for i in range(0, len(points), 500):
        text = "".join(f"x{chr(c)}1{chr(c)} {chr(c)}\n{chr(c)}" for c in points[i : i + 500])
        assert mine.ids(text) == library.encode(" " + text, add_special_tokens=False).ids
