import hashlib
import random

import pytest

from textquarry.llm.queries import QUERIES
from textquarry.llm.suffix_trees import remove_repeats


def brute_force(rows, length=50):
    """``(doc_id, n_words, n_removed, sha)`` by a table of all windows."""
    big = 1 << 63
    first = {}
    split = [(big if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            first[window] = min(first.get(window, big), d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < d:
                gone.update(range(i, i + length))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((None if d == big else d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def got(df):
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_force(rows)
    assert got(QUERIES["op7_substring_dedup"](spark, sf)) == want
    assert sum(0 < r[2] < r[1] for r in want) > 3


def shared_passages(seed):
    """Texts that share passages of lengths about the window's, some passages in most texts, over few words."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(3))
    passage = [[word() for _ in range(n)] for n in (15, 19, 20, 21, 30, 60, 25, 40)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passage) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(30))]
        if rng.random() < 0.1 and len(words) > 3:
            words[rng.randrange(len(words))] = "changed"
        rows.append((rng.choice([None, i, i, i, i // 2]), rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("max_group", [400_000, 30, 0])
def test_groups_of_any_size_give_the_same(spark, make, seed, max_group):
    rows = shared_passages(seed)
    assert got(remove_repeats(make(rows), length=20, max_group=max_group)) == brute_force(rows, 20)


def test_odd_rows_and_kept_text(spark, make):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    some = " ".join(f"x{i}" for i in range(60))
    rows = [(None, None), (None, some), (None, some), (3, some + " tail"), (3, some + " tail"), (4, "front " + some), (5, ""), (6, "a b"), (7, "a b"), (8, long), (9, long)]
    docs = make(rows).selectExpr("*", "1 as id", "2 as digest", "3 as body", "4 as n_words", "5 as at", "6 as begin")
    assert got(remove_repeats(docs)) == brute_force(rows)
    texts = {r.doc_id: r.kept_text for r in remove_repeats(docs, with_text=True).collect() if r.doc_id in (4, 9, 6)}
    assert texts == {4: "front", 9: "", 6: None}
    assert remove_repeats(docs.limit(0)).collect() == []


def test_texts_that_repeat_few_words(spark, make):
    rows = [(1, "la " * 3000), (2, "x " + "la " * 2000 + "y"), (3, "one two three four five " * 400), (4, "two three four five one " * 300 + "tail"), (5, "la " * 49)]
    for max_group in (400_000, 0):
        assert got(remove_repeats(make(rows), max_group=max_group)) == brute_force(rows)
