import pytest
from pyspark.sql import functions as F

from textquarry.functions import validation as v
from textquarry.functions.filters import compile_where, of_sources, source_contains

ROWS = [(1, "en", 10, None), (2, "fr", 20, 1), (3, "de", 30, 0), (4, None, 40, 1)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, lang string, n int, flag int")


@pytest.mark.parametrize(
    "where, ids",
    [
        (None, [1, 2, 3, 4]),
        ({}, [1, 2, 3, 4]),
        ({"lang": "en"}, [1]),
        ({"lang": {"$eq": "fr"}}, [2]),
        ({"lang": {"$ne": "fr"}}, [1, 3, 4]),
        ({"lang": {"$in": ["en", "de"]}}, [1, 3]),
        ({"lang": {"$nin": ["en", "de"]}}, [2, 4]),
        ({"n": {"$gt": 10, "$lte": 30}}, [2, 3]),
        ({"$and": [{"n": {"$gte": 20}}, {"flag": 1}]}, [2, 4]),
        ({"$or": [{"lang": "en"}, {"n": {"$lt": 25}}]}, [1, 2]),
        ({"n": 10, "lang": "fr"}, []),
        ({"unknown": "x"}, []),
        ({"unknown": {"$ne": "x"}}, [1, 2, 3, 4]),
    ],
)
def test_filters(table, where, ids):
    test = compile_where(where, table.columns)
    kept = table if test is None else table.where(test)
    assert sorted(r["id"] for r in kept.select("id").collect()) == ids


@pytest.mark.parametrize(
    "where",
    [
        {"n": {"$regex": "x"}},
        {"$not": []},
        {"$and": []},
        {"$or": "x"},
        {"lang": {"$in": "en"}},
    ],
)
def test_refused_filters(where):
    with pytest.raises(ValueError):
        compile_where(where, ["n", "lang"])


BIG = [{f"k{i}": 1 for i in range(21)}, {"n": {"$in": list(range(51))}}, {"$and": [{"$and": [{"$and": [{"n": 1}]}]}]}]


@pytest.mark.parametrize("where", BIG)
def test_limits_are_those_of_a_request(table, where):
    with pytest.raises(ValueError):
        v.check_request("q", 5, where)
    assert table.where(compile_where(where, table.schema)).count() == {0: 0, 1: 4, 2: 0}[BIG.index(where)]


@pytest.mark.parametrize(
    "where, ids",
    [
        ({"id": "x"}, []),
        ({"id": {"$ne": "x"}}, [1, 2, 3, 4]),
        ({"id": {"$in": ["x", 2]}}, [2]),
        ({"id": {"$nin": ["x"]}}, [1, 2, 3, 4]),
        ({"lang": 5}, []),
        ({"n": {"$gt": "a"}}, []),
        ({"n": {"$gte": 19.5}}, [2, 3, 4]),
        ({"flag": True}, []),
    ],
)
def test_values_of_another_type_match_nothing(table, where, ids):
    assert sorted(r["id"] for r in table.where(compile_where(where, table.schema)).collect()) == ids


def test_source_filter_from_a_table(spark):
    chunks = spark.createDataFrame([(f"s{i}", i) for i in range(80)], "source string, n int")
    sources = spark.createDataFrame([(f"s{i}",) for i in range(60)] * 2, "source string")
    assert of_sources(chunks, sources).count() == 60


def test_filter_reaches_the_scan(spark, tmp_path, table):
    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = stored.where(compile_where({"lang": {"$in": ["en", "de"]}, "n": {"$gt": 5}}, stored.columns)).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in text and "In(lang" in text and "GreaterThan(n,5)" in text


def test_source_search(spark):
    df = spark.createDataFrame([("/A/Report.txt",), ("/b/other.md",)], "source string")
    assert df.where(source_contains(F.col("source"), "  REPORT ")).count() == 1
    assert df.where(source_contains(F.col("source"), "   ")).count() == 2


def test_validation():
    assert v.check_collection_name("my-notes.v1") == "my-notes.v1"
    for bad in ("ab", "-abc", "abc-", "a b c", "x" * 513):
        with pytest.raises(ValueError):
            v.check_collection_name(bad)
    for bad in (-0.1, 1.5):
        with pytest.raises(ValueError):
            v.check_min_score(bad)
    with pytest.raises(ValueError):
        v.check_top_k(0)
    with pytest.raises(ValueError):
        v.check_request("q", 501)
    with pytest.raises(ValueError):
        v.check_request("", 5)
    with pytest.raises(ValueError):
        v.check_description("x" * 501)
    with pytest.raises(ValueError):
        v.check_model_name("/bad")
