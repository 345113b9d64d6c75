import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textquarry.errors import CollectionNotFoundError
from textquarry.functions.embedding import embed, register_embedder
from textquarry.operators import hits as ht
from textquarry.operators.approximate import bucket_of, nearest_probed, plane, probes, recall, with_bucket
from textquarry.operators.nearest import nearest
from textquarry.operators.search import contexts, embed_chunks, embed_queries, search, search_many
from textquarry.schema import COLLECTION

DIMS = 8


def vectors(n, seed):
    return np.random.default_rng(seed).normal(size=(n, DIMS)).astype(np.float32)


@pytest.fixture(scope="module")
def data(spark):
    """A third of the rows are copies of one vector."""
    rows = vectors(300, 1)
    rows[:100] = rows[0]
    queries = vectors(40, 2)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "qid long, embedding array<float>")
    r = spark.createDataFrame(
        [(f"{i:04d}", v.tolist(), i % 3, f"c{i % 3}") for i, v in enumerate(rows)],
        "id string, embedding array<float>, label int, collection string",
    ).repartition(5)
    return queries.astype(float), rows.astype(float), q, r


def brute(queries, rows, k, keep=lambda i: True):
    out = {}
    for q, v in enumerate(queries):
        d = [(round(float(((rows[i] - v) ** 2).sum()), 9), f"{i:04d}") for i in range(len(rows)) if keep(i)]
        out[q] = sorted(d)[:k]
    return out


def collected(df, k=None):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["distance"], r["id"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], atol=1e-8)


@pytest.mark.parametrize("k", [1, 7, 150, 400])
@pytest.mark.parametrize("max_broadcast", [1000, 11])
def test_nearest_is_exact(data, k, max_broadcast):
    queries, rows, q, r = data
    got = collected(nearest(q, r.select("id", "embedding"), k, max_broadcast=max_broadcast))
    same(got, brute(queries, rows, k))


@pytest.mark.parametrize("max_broadcast", [1000, 11])
def test_nearest_within_groups(data, max_broadcast):
    queries, rows, q, r = data
    hits = nearest(q, r.select("id", "embedding", "label"), 4, group="label", max_broadcast=max_broadcast)
    for label in range(3):
        got = collected(hits.where(F.col("label") == label))
        same(got, brute(queries, rows, 4, lambda i: i % 3 == label))


def test_nearest_edge_cases(spark, data):
    _, _, q, r = data
    rows = r.select("id", "embedding")
    assert nearest(q.where("qid < 0"), rows, 3).count() == 0
    assert nearest(q, rows.where("id = 'none'"), 3).count() == 0
    holes = rows.unionByName(spark.createDataFrame([("zz", None)], "id string, embedding array<float>"))
    assert nearest(q, holes, 400).where("id = 'zz'").count() == 0


def test_no_pairs_are_formed(data):
    """A task emits k rows per query; the plan has no join and limits groups before the shuffle."""
    _, _, q, r = data
    plan = nearest(q, r.select("id", "embedding"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("max_queries", [4096, 20])
def test_probed_search(data, max_queries, monkeypatch):
    queries, rows, q, r = data
    monkeypatch.setattr("textquarry.operators.approximate.nearest", _limited(max_queries))
    bits, k = 3, 5
    planes = np.stack([plane(j, DIMS) for j in range(bits)])
    code = lambda m: (m @ planes.T >= 0) @ (1 << np.arange(bits))
    qb, rb = code(queries), code(rows)
    want = {}
    for i in range(len(queries)):
        near = {j for j in range(len(rows)) if bin(qb[i] ^ rb[j]).count("1") <= 1}
        near = near if len(near) >= k else set(range(len(rows)))
        want[i] = brute(queries[i : i + 1], rows, k, near.__contains__)[0]
    same(collected(nearest_probed(q, r, k, bits, 1)), want)
    assert [r["bucket"] for r in q.select("qid", bucket_of(F.col("embedding"), bits).alias("bucket")).orderBy("qid").collect()] == qb.tolist()


def _limited(max_queries):
    def run(*args, **kwargs):
        return nearest(*args, max_broadcast=max_queries, **kwargs)

    return run


def test_probing_all_buckets_is_exact(data):
    queries, rows, q, r = data
    assert sorted(probes(3, 3)) == list(range(8))
    approximate = nearest_probed(q, r, 5, 3, 3)
    exact = nearest(q, r.select("id", "embedding"), 5)
    assert recall(approximate, exact).where("found <> wanted").count() == 0


def test_stored_buckets_are_pruned(spark, data, tmp_path):
    """Buckets that no query probes are not read, and nothing is read again when every query finds its k."""
    _, _, q, r = data
    with_bucket(r, 3).write.partitionBy("bucket").parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    one = q.where("qid = 3")
    few = nearest_probed(one, stored, 5, 3, 0)
    same(collected(few), collected(nearest_probed(one, r, 5, 3, 0)))
    bucket = one.select(bucket_of(F.col("embedding"), 3)).first()[0]
    held = stored.where(F.col("bucket") == bucket).count()
    assert held < stored.count()
    files = spark.read.parquet(str(tmp_path / "rows" / f"bucket={bucket}"))
    if held >= 5:
        assert {x["id"] for x in few.collect()} <= {x["id"] for x in files.select("id").collect()}


def test_approximate_search_carries_columns(spark, data):
    _, _, q, r = data
    exact = search(q, r, 5, collection="c1", carry=["label"])
    near = search(q, r, 5, collection="c1", carry=["label"], approximate=True)
    assert near.columns == exact.columns and near.count() == exact.count()
    found = recall(near.select("qid", "id"), exact).agg(F.sum("found") / F.sum("wanted")).first()[0]
    assert found >= 0.7


def test_one_id_in_two_collections(spark, data):
    """The same ids in two collections give every hit once, whether queries are sent at once or in blocks."""
    _, _, q, r = data
    both = r.drop("collection").withColumn("collection", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("text", F.concat("collection", F.lit("-"), "id"))
    wanted = None
    for blocks in (1000, 11):
        hits = search_many(q, both, ["a", "b"], 3, carry=["text"], max_broadcast=blocks)
        rows = sorted(tuple(x) for x in hits.select("qid", "rank", "collection", "id", "text").collect())
        assert all(t == f"{c}-{i}" for _, _, c, i, t in rows) and len(rows) == 3 * 40
        assert wanted in (None, rows)
        wanted = rows
        plain = search(q, both, 4, carry=["text"], max_broadcast=blocks)
        assert plain.count() == 4 * 40 and plain.select("qid", "text").distinct().count() == 4 * 40


def test_only_keys_move(data):
    _, _, q, r = data
    plan = nearest(q, r.withColumn("text", F.lit("long")), 3)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window ") :]
    assert "MapInArrow" in window and "text" not in window.split("MapInArrow")[0].split("Join")[-1]


def test_score_threshold_comes_after_the_rank(spark):
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, embedding array<float>")
    r = spark.createDataFrame([("a", [0.2236, 0.0]), ("b", [1.4142, 0.0]), ("c", [0.3, 0.0])], "id string, embedding array<float>")
    hits = search(q, r, k=2, min_score=0.5, carry=[]).orderBy("rank").collect()
    assert [(h["id"], h["score"], h["distance"]) for h in hits] == [("a", 0.9524, 0.05), ("c", 0.9174, 0.09)]
    assert [h["id"] for h in search(q, r, k=2, min_score=0.94, carry=[]).collect()] == ["a"]
    plan = search(q, r, k=2, min_score=0.94, carry=[])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Window")


def test_hits_have_defaults(spark):
    q = spark.createDataFrame([(0, [0.0])], "qid long, embedding array<float>")
    r = spark.createDataFrame([("a", [1.0], "text", None)], "id string, embedding array<float>, text string, source string")
    hit = search(q, r, k=1).first()
    assert (hit["source"], hit["source_type"], hit["chunk"], hit["doc_title"], hit["score"]) == ("", "file", 0, "", 0.5)


def test_merge_of_collections(spark):
    q = spark.createDataFrame([(0, [0.0])], "qid long, embedding array<float>")
    r = spark.createDataFrame(
        [("a1", [0.3162], "a"), ("a2", [0.4472], "a"), ("b1", [0.9487], "b"), ("b2", [0.2236], "b"), ("b3", [0.4472], "b")],
        "id string, embedding array<float>, collection string",
    )

    def ids(names, k, **how):
        return [h["id"] for h in search_many(q, r, names, k=k, carry=[], **how).orderBy("rank").collect()]

    assert ids(["a", "b"], 2) == ["b2", "a1"]
    assert ids(["a", "missing", "b"], 4) == ["b2", "a1", "a2", "b3"]
    assert ids(["b", "a"], 4) == ["b2", "a1", "b3", "a2"]  # equal scores: caller order
    assert ids(["a", "b"], 2, cut=False) == ["b2", "a1", "a2", "b3"]
    assert ids(["a", "a"], 2) == ["a1", "a1"]
    assert ids(["missing"], 3) == []
    assert ids(["a", "b"], 4, min_score=0.9) == ["b2", "a1"]


def test_text_search_end_to_end(spark):
    chunks = spark.createDataFrame(
        [("c", "1", "the quick brown fox", "fox.txt"), ("c", "2", "rain falls on the plain", "rain.txt"), ("d", "3", "a fox in the rain", "x.txt")],
        "collection string, id string, text string, source string",
    )
    q = embed_queries(spark.createDataFrame([(1, "quick fox"), (2, "zzz")], "qid long, query_text string"))
    collections = spark.createDataFrame([("c", "m", "")], COLLECTION)
    hits = search(q, embed_chunks(chunks), k=1, collection="c", collections=collections)
    assert {h["qid"]: h["source"] for h in hits.collect()}[1] == "fox.txt" and hits.count() == 2
    with pytest.raises(CollectionNotFoundError):
        search(q, embed_chunks(chunks), collection="none", collections=collections)
    out = contexts(q, embed_chunks(chunks), prefix=" Be kind. ", k=2, collection="c").where("qid = 1").first()
    assert out["context"] == "the quick brown fox\n\nrain falls on the plain"
    assert out["prompt"].startswith("Be kind.\n\n") and out["prompt"].endswith("CONTEXT:\n" + out["context"])


def test_embedder_registry(spark):
    register_embedder("lengths", lambda: lambda texts: [[float(len(t))] for t in texts])
    df = spark.createDataFrame([("abc",)], "t string")
    assert df.select(embed(F.col("t"), "lengths")).first()[0] == [3.0]
    with pytest.raises(ValueError):
        embed(F.col("t"), "unknown")
    zero = df.select(embed(F.lit(""))).first()[0]
    assert len(zero) == 256 and not any(zero)


def test_citations_and_neighbours(spark):
    hits = spark.createDataFrame([(1, 1, "a", "s1"), (1, 2, "b", "s1"), (1, 3, "c", "s2")], "qid long, rank int, id string, source string")
    assert [(r["rank"], r["source"]) for r in ht.cited_sources(hits).orderBy("rank").collect()] == [(1, "s1"), (3, "s2")]
    got = [(r["previous_id"], r["next_id"]) for r in ht.hit_neighbours(hits).orderBy("rank").collect()]
    assert got == [("a", "b"), ("a", "c"), ("b", "c")]


def test_recent_distinct(spark):
    log = spark.createDataFrame([("u", "x", 1), ("u", "y", 2), ("u", "x", 3), ("u", "z", 0)], "user string, text string, ts long")
    got = ht.recent_distinct(log, "user", "text", "ts", cap=2).orderBy("position").collect()
    assert [(r["text"], r["last_used"]) for r in got] == [("x", 3), ("y", 2)]


def test_answers_by_a_generator_of_ones_own(spark):
    @F.pandas_udf("string")
    def shout(prompts: pd.Series) -> pd.Series:
        return prompts.str.upper()

    prompts = spark.createDataFrame([(1, "ctx", "why?"), (2, "ctx", None)], "qid long, context string, prompt string")
    assert {r["qid"]: r["answer"] for r in ht.generate_answers(prompts, shout).collect()} == {1: "WHY?", 2: None}


def test_more_blocks_are_no_more_jobs(spark, data):
    """Rows are packed once, and every block of queries meets them in the same job."""
    _, _, q, r = data

    def jobs(blocks, **kwargs):
        spark.sparkContext.setJobGroup(f"blocks-{blocks}-{len(kwargs)}", "")
        try:
            nearest(q, r.select("id", "embedding", "label"), 3, max_broadcast=blocks, **kwargs).collect()
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks-{blocks}-{len(kwargs)}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(2) <= jobs(20) + 2
    assert jobs(2, group="label") <= jobs(20, group="label") + 2


def test_scores_out_of_the_range_of_single_floats(spark):
    """What single floats cannot tell apart is measured in double precision; a row that is no number hides no other."""
    rng = np.random.default_rng(7)
    for centre, width in ((1000.0, 0.01), (1e20, 1e18), (0.0, 1e-6)):
        v = centre + rng.normal(size=(200, 8)) * width
        rows = spark.createDataFrame([(f"{i:04d}", x.tolist()) for i, x in enumerate(v)] + [("nan", [float("nan")] * 8)], "id string, embedding array<double>")
        q = rows.where("id < '0020'").select(F.col("id").alias("qid"), "embedding")
        for blocks in (1000, 7):
            got = {(h.qid, h["rank"]): h for h in nearest(q, rows.repartition(3), 4, max_broadcast=blocks).collect()}
            assert len(got) == 80
            for i in range(20):
                far = np.sort(((v - v[i]) ** 2).sum(1))
                for n in range(4):
                    assert abs(got[f"{i:04d}", n + 1].distance - far[n]) <= max(1e-8, 1e-9 * centre**2)


def test_scores_are_held_in_small_pieces():
    import tracemalloc

    import pyarrow as pa

    from textquarry.operators.nearest import _Best

    rng = np.random.default_rng(3)
    best, vectors = _Best(rng.normal(size=(4096, 16)), 5, ["id"]), rng.normal(size=(4000, 16))
    tracemalloc.start()
    best.offer(vectors, pa.table({"id": np.arange(4000)}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
