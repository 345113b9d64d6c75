import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import mixing
from textquarry.llm.queries import QUERIES

TEST = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    rows = [(i, int(rng.integers(1, 500)), [float(x) for x in row]) for i, row in enumerate(p)]
    return rows, spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>").repartition(3)


def totals(rows, rate):
    return sum(np.array(p) * n * rate[i] for i, n, p in rows)


@pytest.mark.parametrize("weights", [[0.5, 0.3, 0.2], [1, 1, 1], [0.6, 0.4, 0.0]])
def test_rates_are_those_of_plain_projected_gradients(small, weights):
    rows, df = small
    options = mixing.MixingOptions(max_steps=200, steps_per_table=4, tolerance=1e-3)
    fit = mixing.fit_rates(df, weights, 60_000.0, options=options)
    got = {r.doc_id: r.rate for r in fit.rated.collect()}
    n, p = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    inverse = np.linalg.inv((p * n[:, None]).T @ p)
    rate = np.full(len(rows), 60_000.0 / n.sum())
    for _ in range(fit.steps):
        rate = np.maximum(0, rate - p @ inverse @ (p.T @ (n * rate) - fit.target))
    assert np.allclose([got[i] for i in range(len(rows))], rate, atol=1e-8)
    assert min(got.values()) >= 0 and np.allclose(totals(rows, got), fit.reached)
    if 0.0 not in weights:
        assert np.abs(fit.reached - fit.target).sum() <= 1e-3 * 60_000
    else:  # soft memberships put some of every domain in every document: nothing but rates of zero reach zero
        before = totals(rows, dict.fromkeys(range(len(rows)), 60_000.0 / n.sum()))
        assert np.abs(fit.reached - fit.target).sum() < 0.5 * np.abs(before - fit.target).sum()


def test_query_rates_every_document_and_holds_on_unseen_labels(spark):
    rows = QUERIES["op8_mix_sources"](spark, TEST).collect()
    docs = spark.read.parquet(f"{TEST}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(abs(r.p_high + r.p_low + r.p_toxic - 1) < 1e-9 and r.rate >= 0 and int(r.rate) <= r.copies <= r.rate + 1 for r in rows)
    labels = spark.read.parquet(f"{TEST}/labels.parquet").withColumn("domain", mixing.label_domain(F.col("quality"), F.col("toxic")))
    learnt, unseen = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = mixing.train(docs, learnt, mixing.DOMAINS)
    held = mixing.classified(docs, model, ("doc_id",)).join(unseen, "doc_id").collect()
    right = np.mean([mixing.DOMAINS[int(np.argmax(r.p))] == r.domain for r in held])
    assert len(held) > 100 and right >= 0.85


def test_toxic_words_are_learnt_and_clean_documents_stay(spark, make):
    rng = np.random.default_rng(1)
    prose = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80))
    rows = [(i, prose() + (" you idiot scum" if i % 10 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = make(rows).selectExpr("*", "1 as p", "2 as row", "3 as carried", "4 as rate", "5 as found_")
    kept = mixing.mix(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(600) if i % 10}


def test_odd_rows(spark, make):
    long = "word " * 300_000
    docs = make([(None, None), (None, "x"), (1, ""), (1, ""), (2, long), (3, "???")])
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (None, 1, 0), (3, None, 0), (3, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mixing_rates(docs, labels).rated.collect()
    assert len(got) == 6 and all(r.rate is not None and abs(sum(r.p) - 1) < 1e-9 for r in got)
    no_labels = mixing.mixing_rates(docs, labels.limit(0)).rated.collect()
    assert all(np.allclose(r.p, 1 / 3) for r in no_labels)
    assert mixing.mixing_rates(docs.limit(0), labels).rated.collect() == []
    assert mixing.mix(docs.limit(0), labels).collect() == []


def test_plan_has_no_python(spark, small):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = mixing.mixing_rates(docs, labels).rated._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
