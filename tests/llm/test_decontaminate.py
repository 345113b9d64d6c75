import random

import numpy as np
import pytest

from textquarry.llm import decontaminate as dc
from textquarry.llm.fm_index import FMIndex, suffix_order


def random_tokens(rng, n, kinds):
    tokens = [rng.randrange(kinds + 1) for _ in range(n)]
    return np.array(tokens + [0], np.int32)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_occurrence(seed):
    rng = random.Random(seed)
    tokens = random_tokens(rng, 400, rng.choice([1, 2, 5]))
    if seed == 5:
        tokens = np.array([1] * 300 + [0], np.int32)
    n_symbols = int(tokens.max()) + 1
    index = FMIndex(tokens, n_symbols)
    text = tokens.tolist()
    phrases = [tuple(text[i : i + k]) for i in rng.sample(range(300), 40) for k in (1, 3, 6) if 0 not in text[i : i + k]]
    phrases += [tuple(rng.randrange(1, n_symbols) for _ in range(4)) for _ in range(20)]
    rows, lengths = np.zeros((len(phrases), 6), np.int64), np.array(list(map(len, phrases)))
    for r, p in zip(rows, phrases):
        r[6 - len(p) :] = p
    low, high = index.search(rows, lengths)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text)) if tuple(text[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffixes_are_sorted():
    rng = random.Random(9)
    tokens = random_tokens(rng, 300, 2)
    zero = iter(range(1, 10_000))
    text = [next(zero) if t == 0 else 10_000 + t for t in tokens.tolist()]
    assert suffix_order(tokens).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_order(np.zeros(0, np.int32)).tolist() == []


def test_blocks_of_the_benchmark_give_the_same(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = {r.doc_id: r for r in dc.find_contamination(docs, items, window=3).drop("tag").collect()}
    parts = {r.doc_id: r for r in dc.find_contamination(docs, items, window=3, block_bytes=1500).drop("tag").collect()}
    assert whole == parts and sum(r.contaminated for r in whole.values()) > 5


def test_contaminated_documents_are_dropped_and_others_kept(spark, make):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, "front " + item.upper() + " back"), (2, "front " + item[:20]), (3, None), (3, None), (None, item)]
    docs = make(rows).selectExpr("*", "1 as body", "2 as tag")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for size in (1 << 20, 10):
        kept = dc.drop_contaminated(docs, items, block_bytes=size)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 3]
    assert dc.drop_contaminated(docs, items.limit(0)).count() == 5
