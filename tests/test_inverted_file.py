import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators.approximate import recall
from textquarry.operators.inverted_file import InvertedFile, nearest_filed, train, with_cell, write_cells
from textquarry.operators.nearest import nearest
from textquarry.operators.search import search

SCHEMA = "id long, embedding array<double>, label int"


@pytest.fixture(scope="module")
def clustered(spark):
    """Twenty clouds of vectors, one with a third of them, copies and a few rows without a vector."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 4
    which = np.where(rng.random(3000) < 0.33, 0, rng.integers(1, 20, 3000))
    vectors = centres[which] + rng.normal(size=(3000, 16))
    vectors[100:130] = vectors[100]
    rows = [(i, [float(x) for x in v], int(w)) for i, (v, w) in enumerate(zip(vectors, which, strict=True))]
    rows += [(3000, None, 0), (3001, None, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def asked(rows, step=20):
    return rows.where(F.col("id") % step == 0).select(F.col("id").alias("qid"), "embedding")


def share(found, wanted):
    got = recall(found, wanted).agg(F.sum("found"), F.sum("wanted")).first()
    return got[0] / got[1]


def test_wanted_recall_is_reached_with_few_cells(spark, clustered):
    index = train(clustered, k=5, recall=0.95)
    assert len(index.centroids) == 55
    queries = asked(clustered)
    found, wanted = nearest_filed(queries, clustered, index, 5), nearest(queries, clustered, 5)
    assert share(found, wanted) >= 0.95
    # Distances are exact, ranks gapless, and every query has its hits.
    rows = {(r.qid, r["rank"]): r for r in found.collect()}
    vectors = {r.id: r.embedding for r in clustered.collect()}
    assert len(rows) == 5 * queries.where("embedding IS NOT NULL").count()
    for r in rows.values():
        assert r.distance == pytest.approx(sum((a - b) ** 2 for a, b in zip(vectors[r.qid], vectors[r.id], strict=True)), abs=1e-6)
    far = np.sqrt(index.far(np.array([vectors[r.qid] for r in rows.values()])))
    assert (far <= index.margin * far.min(1)[:, None]).mean() < 0.5


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    queries = asked(rows, 1)
    assert share(nearest_filed(queries, rows, train(rows), 5), nearest(queries, rows, 5)) >= 0.9


def test_stored_cells_prune_what_is_read(spark, clustered, tmp_path):
    index = train(clustered, recall=0.9)
    stored = write_cells(clustered, index, str(tmp_path / "rows"))
    index.save(spark, str(tmp_path / "index"))
    again = InvertedFile.load(spark, str(tmp_path / "index"))
    assert np.array_equal(again.centroids, index.centroids) and again.margin == index.margin
    one = asked(clustered).orderBy("qid").limit(1)
    hits = search(one, stored, k=5, carry=["label"], approximate=again)
    plain = search(one, clustered, k=5, carry=["label"], approximate=index)
    key = lambda df: sorted((r["rank"], r.id, round(r.distance, 6), r.label) for r in df.collect())
    assert key(hits) == key(plain) and len(key(hits)) == 5
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # one plan, whose scan counts the files that it read
    try:
        found = nearest_filed(one, stored, again, 5)
        found.collect()
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        (scan,) = [leaves.apply(i) for i in range(leaves.size())]
        files = scan.metrics().apply("numFiles").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < files < len(stored.inputFiles()) / 2


def test_cells_too_small_for_k_are_followed_by_others(spark, clustered):
    index = InvertedFile(train(clustered).centroids, 1.0)  # the nearest cell alone
    few = clustered.where("id < 40")
    got = nearest_filed(asked(clustered), few, index, 5).groupBy("qid").count().collect()
    assert {r["count"] for r in got} == {5}
    assert nearest_filed(asked(clustered), few.limit(3), index, 5).groupBy("qid").count().select("count").distinct().collect()[0][0] == 3


def test_blocks_of_queries_give_the_same(spark, clustered, monkeypatch):
    index = train(clustered)
    queries = asked(clustered, 50)
    rows = lambda: sorted((r.qid, r["rank"], r.id, r.distance) for r in nearest_filed(queries, clustered, index, 3).collect())
    whole = rows()
    monkeypatch.setattr("textquarry.operators.inverted_file.MAX_HELD", 200)
    assert rows() == whole


def test_a_task_gives_k_hits_per_query_however_many_cells_it_probes(spark, clustered):
    from textquarry.operators.inverted_file import probed_cells
    from textquarry.operators.nearest import _nearest_broadcast

    index = InvertedFile(train(clustered).centroids, 100.0)  # every cell is probed
    rows = with_cell(clustered, index).where("cell IS NOT NULL").select("id", "embedding", "cell").coalesce(2)
    sizes = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    queries = probed_cells(asked(clustered), index, sizes, 5).withColumnRenamed("cells", "cell")
    assert queries.select(F.min(F.size("cell"))).first()[0] == len(sizes) > 20
    hits = _nearest_broadcast(queries.toArrow(), queries, rows, 5, None, "cell", ["id"])
    assert hits.count() <= 2 * 5 * queries.count()


def test_odd_tables(spark, clustered):
    none = clustered.limit(0)
    index = train(none)
    assert nearest_filed(asked(clustered), none, index, 5).collect() == []
    index = train(clustered)
    assert nearest_filed(none.select(F.col("id").alias("qid"), "embedding"), clustered, index, 5).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(50)] + [(None, [1.0, 2.0], 0)], SCHEMA)
    index = train(same)
    assert len(index.centroids) == 1 and with_cell(same, index).select("cell").distinct().count() == 1
    assert sorted(r.id for r in nearest_filed(asked(same, 50), same, index, 5).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        train(same, recall=0)
