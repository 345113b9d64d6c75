import pytest

from textquarry.llm import quality
from textquarry.llm.quality import QualityRules

GOOD = " ".join(f"w{i}" for i in range(60))


def test_a_bad_host_takes_its_documents_with_it_and_small_hosts_are_shrunk(spark, make):
    rows = [(i, GOOD + f" g{i}", f"good{i % 20}") for i in range(400)]
    rows += [(1000 + i, "too short", "bad") for i in range(90)] + [(2000 + i, GOOD + f" b{i}", "bad") for i in range(10)]
    rows += [(3000, "too short", "tiny")] + [(3001, GOOD + " t", None), (3002, "short", None)]
    got = {r.doc_id: r for r in quality.judge(make(rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(400))
    assert not any(got[2000 + i].kept or got[2000 + i].base_failed for i in range(10))
    assert got[3000].base_failed and not got[3000].host_rejected
    assert got[3001].kept and not got[3002].kept


def test_rates_are_shrunk_as_by_hand(spark):
    rows = [("a", 8, 10), ("b", 1, 10), ("c", 0, 4), ("d", 3, 3)]
    df = spark.createDataFrame([(h, i < k) for h, k, n in rows for i in range(n)], "host string, failed boolean")
    got = {r.host: r.rate for r in quality.host_verdicts(df, QualityRules()).collect()}
    rates = [k / n for _, k, n in rows]
    mean = sum(rates) / 4
    var = sum((r - mean) ** 2 for r in rates) / 4 - mean * (1 - mean) * sum(1 / n for *_, n in rows) / 4
    weight = min(max(mean * (1 - mean) / var - 1, 2), 1000)
    for h, k, n in rows:
        assert got[h] == pytest.approx((k + mean * weight) / (n + weight))


def test_kept_rows_have_their_own_columns(spark, make):
    docs = make([(1, GOOD), (1, GOOD), (None, GOOD), (2, "x"), (3, None)]).selectExpr("*", "1 as m", "2 as host", "3 as metrics", "4 as carried", "5 as body")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]
    assert quality.keep_good(docs.limit(0)).collect() == []


def test_plan_has_no_python(spark, make):
    plan = quality.judge(make([(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
