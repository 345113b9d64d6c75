import random

from textquarry.llm import near_copies
from textquarry.llm.near_copies import keep_one


def plain_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Least id of every group linked by a five-word Jaccard similarity of 0.8, by comparing all pairs."""
    sets = [plain_shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                label[max(top(i), top(j))] = min(top(i), top(j))
    return sorted(rows[i][0] for i in range(len(rows)) if top(i) == i)


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_stage_links_copies_at_similarities_around_the_threshold(spark, make):
    rng = random.Random(11)
    rows = []
    for _ in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 100, 300, 1000]))]
        rows.append(" ".join(words))
        rows += [changed(rng, words, max(1, int(len(words) * share))) for share in rng.sample([0.005, 0.015, 0.02, 0.023, 0.026, 0.03, 0.05], 3)]
    common = " ".join(f"c{i}" for i in range(40))
    rows += [f"{common} " + " ".join(f"x{rng.randrange(9000)}" for _ in range(40)) for _ in range(30)]
    base = [f"b{i}" for i in range(80)]
    rows += [changed(rng, base, 1) for _ in range(60)]  # a group whose members differ by twice as much from each other
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert sorted(r.doc_id for r in keep_one(make(rows)).collect()) == plain_kept(rows)


def test_stage_equals_brute_force_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == plain_kept(rows)


def test_odd_rows(spark, make):
    long = "alpha beta gamma delta " * 50_000
    rows = [(None, None), (4, ""), (7, " \n"), (1, "One two three"), (2, "one TWO three"), (2, "one TWO three"), (3, long), (None, long), (None, "a b"), (None, "A b")]
    docs = make(rows).selectExpr("*", "1 as node", "2 as tag_", "3 as id_", "4 as row", "5 as best", "6 as keys")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4]
    assert keep_one(docs.limit(0)).collect() == []


def test_candidates_reach_nearly_all_pairs_at_the_threshold():
    rng = random.Random(2)
    found, every = 0, 0
    while every < 400:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 600]))]
        a, b = (near_copies.shingles(near_copies.tokens_of(t)) for t in (" ".join(words), changed(rng, words, max(1, len(words) * 22 // 1000))))
        common = len(set(a.tolist()) & set(b.tolist()))
        if not 0.8 <= common / (len(a) + len(b) - common) < 0.86:
            continue
        (f, k), (g, m) = near_copies.sketch(a), near_copies.sketch(b)
        every += 1
        found += bool(set(k) & set(m)) and ((f ^ g) & (1 << 64) - 1).bit_count() <= near_copies.FAR
    assert found >= 398


def test_pigeonring_finds_near_copies_that_share_no_band(spark, make):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(6000)]
    texts = [" ".join(words), *(changed(rng, words, 1) for _ in range(3)), " ".join(f"v{i}" for i in range(6000)), None]
    docs = make(list(enumerate(texts)))
    tags = {r[0]: r[1] for r in near_copies._texts(docs).select("id_", "tag_").collect()}
    rows, fps = [], []
    for i, text in enumerate(texts):
        hashes = near_copies.shingles(near_copies.tokens_of(text))
        fps.append(near_copies.sketch(hashes)[0])
        rows.append((near_copies._node(near_copies.tokens_of(text)), i, tags[i], len(hashes), fps[-1], [i]))  # a key of its own
    differ = [((fps[0] ^ fp) & (1 << 64) - 1).bit_count() for fp in fps]
    assert max(differ[:4]) <= 4 < differ[4]
    links = near_copies.similar(docs, spark.createDataFrame(rows, "node long, id_ long, tag_ long, n long, fp long, keys array<long>"))
    groups = {r["node"]: r["root"] for r in near_copies.components(links).select("node", F.col("root")).collect()}
    assert set(groups) == {r[0] for r in rows[:4]} and len(set(groups.values())) == 1
