import random

import numpy as np
import xxhash

from textquarry.llm import simhash
from textquarry.llm.queries import QUERIES


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Of every fingerprint the least index of a fingerprint reachable by links of 4 or fewer bits, by comparing all."""
    values = np.array(fps, np.uint64)
    label = list(range(len(fps)))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 4) for v in values]
    while changed:
        changed = False
        for i, other in enumerate(near):
            low = min(label[j] for j in other)
            if low < label[i]:
                label[i], changed = low, True
    return label


def rows_of(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = [plain_fingerprint(r.text) for r in docs]
    want = [(r.doc_id, f"{f:016x}", docs[c].doc_id) for r, f, c in zip(docs, fps, plain_components(fps))]
    assert rows_of(QUERIES["op4_simhash"](spark, sf)) == want


def near_values(seed, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        value = rng.choice(base)
        for _ in range(rng.randrange(7)):
            value ^= 1 << rng.randrange(64)
        out.add(value)
    return sorted(out)


def test_links_connect_what_all_links_connect(spark):
    values = near_values(1, 700)
    want = plain_components(values)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").repartition(3)
    for bound in (1 << 16, 12):  # the second files large buckets anew
        edges = {(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(nodes, bound).collect()}
        assert all((a ^ b).bit_count() <= 4 for a, b in edges)
        label = {v: v for v in values}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(label[a], label[b])
                for x in (a, b):
                    if label[x] != low:
                        label[x], changed = low, True
        groups = {}
        for v, w in zip(values, want):
            groups.setdefault(w, set()).add(label[v])
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_odd_rows(spark, make):
    long = "alpha beta gamma delta " * 50_000
    rows = [(None, None), (4, ""), (7, " \n"), (1, "One two three"), (2, "one TWO three"), (2, "one TWO three"), (3, long), (None, long)]
    got = simhash.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {4} and len(zero) == 3
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in got if r.fingerprint == f"{plain_fingerprint(long):016x}"} == {3}
    assert simhash.near_duplicates(make(rows).limit(0)).collect() == []


def test_keep_one_keeps_columns_and_one_of_each_group(spark, make):
    rows = [(1, "one two three"), (2, "one two three"), (1, "one two three"), (None, None), (None, None), (9, "x y z w v")]
    docs = make(rows).selectExpr("*", "1 as fp", "2 as tag_", "3 as id_", "4 as row", "5 as root")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 9)]
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    from textquarry.llm.components import components

    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(199)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(200)}, 1000: 1000, 1001: 1000}
