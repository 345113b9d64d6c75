import random
import zlib

import pytest

from textquarry.llm import sharding
from textquarry.llm.queries import QUERIES


def plain_cuts(sizes, shards):
    """Smallest capacity over sizes in order, and the greedy cuts with it."""

    def walk(capacity):
        cuts, held = [], 0
        for i, s in enumerate(sizes):
            if s > capacity:
                return None
            if held + s > capacity:
                cuts.append(i)
                held = 0
            held += s
        return cuts if len(cuts) < shards else None

    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if walk(middle) is not None else (middle + 1, high)
    return low, walk(low)


@pytest.mark.parametrize("n, shards, kind", [(1, 5, 1), (3, 5, 9), (500, 7, 5), (3000, 40, 300), (60_000, 40, 3), (2000, 1, 9)])
def test_cuts_are_those_of_the_plain_search(spark, n, shards, kind):
    rng = random.Random(n)
    sizes = {rng.getrandbits(64): rng.choice([rng.randrange(1, 50), rng.randrange(1, 50 * kind)]) for _ in range(n)}
    rows = [(sharding._signed(k), s) for k, s in sizes.items()]
    order = sorted(sizes)
    capacity, cuts = plain_cuts([sizes[k] for k in order], shards)
    got = sharding.find_cuts(spark.createDataFrame(rows, "key long, size long"), shards)
    assert got[0] == capacity

    def part(at, starts):
        return sum(at >= s for s in starts)

    want = [order[i] for i in cuts]
    assert [part(k, got[1]) for k in order] == [part(k, want) for k in order]


def test_keys_that_share_their_first_bits(spark):
    keys = [(7 << 50) + i for i in range(300)]
    groups = spark.createDataFrame([(k, 10) for k in keys], "key long, size long")
    assert sharding.find_cuts(groups, 3) == (1000, [keys[100], keys[200]])


def check(rows, texts, shards=40):
    by_shard, of_text = {}, {}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        by_shard.setdefault(r.shard, []).append(r)
        of_text.setdefault(text, set()).add(r.shard)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in of_text.values())
    return {s: sum(r.size for r in rows) for s, rows in by_shard.items()}


def test_query_balances_bytes(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op6_shards"](spark, sf).collect()
    assert len(rows) == len(docs)
    size = check(rows, {r.doc_id: r.text for r in docs})
    groups = {}
    for r in rows:
        groups[docs[0].text if False else (r.text_crc32, r.size)] = groups.get((r.text_crc32, r.size), 0) + r.size
    assert max(size.values()) <= sum(size.values()) / 40 + max(groups.values())


def test_a_text_with_a_third_of_all_rows_has_a_shard_of_its_own(spark, make):
    texts = {i: "hot text " * 20 if i % 3 == 0 else f"text {i} " * 20 for i in range(900)}
    rows = sharding.assign_shards(make(list(texts.items())), shards=10, rows_per_block=20).collect()
    size = check(rows, texts, 10)
    hot = {r.shard for r in rows if r.doc_id % 3 == 0}
    assert len(hot) == 1 and size[next(iter(hot))] == sum(r.size for r in rows if r.doc_id % 3 == 0)
    others = [v for s, v in size.items() if s not in hot]
    assert len(others) == 9 and max(others) < 1.1 * min(others)


def test_odd_rows(spark, make):
    docs = make([(None, None), (None, ""), (1, ""), (1, "a"), (1, "a"), (2, "x" * 3_000_000)])
    docs = docs.selectExpr("*", "1 as size", "2 as shard", "3 as block", "4 as key")
    rows = sharding.assign_shards(docs, shards=4).collect()
    assert len(rows) == 6
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.size == 16}) == 1
    assert sharding.assign_shards(docs.limit(0)).collect() == []
