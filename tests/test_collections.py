import logging

import pytest
from pyspark.sql import functions as F

from textquarry.errors import CollectionExistsError, CollectionNotFoundError
from textquarry.operators import collections as coll
from textquarry.operators.changes import purge, purge_counts
from textquarry.schema import COLLECTION

CHUNKS = [
    ("notes", "1", "/d/a.txt"),
    ("notes", "2", "/d/a.txt"),
    ("notes", "3", "/d/b.txt"),
    ("notes", "4", "/x.db::articles"),
    ("notes", "5", ""),
    ("notes", "6", None),
    ("other", "1", "/d/a.txt"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "collection string, id string, source string")


@pytest.fixture(scope="module")
def collections(spark):
    rows = [("notes", "m1", "mine"), ("other", "m2", None), ("empty", "", "")]
    return spark.createDataFrame(rows, COLLECTION)


def test_listing(chunks, collections):
    assert [r["name"] for r in coll.list_collections(collections).collect()] == ["empty", "notes", "other"]
    assert [r[0] for r in coll.embedding_models(collections).collect()] == ["m1", "m2"]
    assert [r["source"] for r in coll.sources(chunks, "notes").collect()] == ["/d/a.txt", "/d/b.txt", "/x.db::articles"]
    assert [tuple(r) for r in coll.source_counts(chunks, "notes").collect()] == [("/d/a.txt", 2), ("/d/b.txt", 1), ("/x.db::articles", 1)]
    assert coll.scan_collection(chunks, "other", ["source"]).collect()[0].asDict() == {"id": "1", "source": "/d/a.txt"}


def test_stats(chunks, collections):
    assert tuple(coll.stats_of(chunks, collections, "notes").first()) == ("notes", 6, 3, "m1", "mine")
    assert tuple(coll.stats_of(chunks, collections, "empty").first()) == ("empty", 0, 0, "", "")
    with pytest.raises(CollectionNotFoundError):
        coll.stats_of(chunks, collections, "none")


def test_create(collections, caplog):
    assert coll.create_collection(collections, "fresh", "m1").count() == 4
    with caplog.at_level(logging.WARNING):
        assert coll.create_collection(collections, "notes", "m9").count() == 3
    assert "m1" in caplog.text and coll.stored_model(collections, "notes", "m9") == "m1"
    assert coll.stored_model(collections, "empty", "m9") == "m9"


def test_delete(spark, chunks):
    assert coll.delete_source(chunks, "notes", "/d/a.txt").count() == 5
    gone = spark.createDataFrame([("/d/a.txt",), ("/d/b.txt",), ("/none",)], "source string")
    assert coll.delete_sources(chunks, "notes", gone).count() == 4
    counts = {r["source"]: r["chunks_deleted"] for r in coll.deletion_counts(chunks, "notes", gone).collect()}
    assert counts == {"/d/a.txt": 2, "/d/b.txt": 1, "/none": 0}


def test_purge(spark, chunks, collections):
    live = spark.createDataFrame([("/d/b.txt",), ("/x.db",)], "source string")
    own = chunks.where("collection = 'notes'")
    assert sorted(r["id"] for r in purge(own, live).collect()) == ["3", "4", "5", "6"]
    assert tuple(purge_counts(own, live).first()) == (6, 2)
    kept, counts = coll.purge_collection(chunks, collections, "notes", live)
    assert kept.count() == 5 and tuple(counts.first()) == (6, 2)
    _, counts = coll.purge_collection(chunks, collections, "none", live)
    assert tuple(counts.first()) == (0, 0)
    with pytest.raises(CollectionNotFoundError):
        coll.purge_collection(chunks, collections, "none", live, raise_if_missing=True)


def test_reset(chunks, collections):
    with pytest.raises(ValueError, match="confirm"):
        coll.reset(chunks, collections, "notes")
    left, names = coll.reset(chunks, collections, "notes", confirm=True)
    assert left.count() == 1 and names.count() == 2
    left, names = coll.reset(chunks, collections, "none", confirm=True)
    assert left.count() == 7 and names.count() == 3


def test_rename(chunks, collections):
    renamed, names = coll.rename(chunks, collections, "notes", "my-notes")
    assert renamed.where("collection = 'my-notes'").count() == 6 and renamed.count() == 7
    assert names.where("name = 'my-notes' AND description = 'mine'").count() == 1
    with pytest.raises(CollectionNotFoundError):
        coll.rename(chunks, collections, "none", "fine")
    with pytest.raises(CollectionExistsError):
        coll.rename(chunks, collections, "notes", "other")
    with pytest.raises(ValueError):
        coll.rename(chunks, collections, "notes", "-bad-")


def test_describe(collections):
    got = coll.describe(collections, "notes", "new text").where(F.col("name") == "notes").first()
    assert tuple(got) == ("notes", "m1", "new text")
    with pytest.raises(CollectionNotFoundError):
        coll.describe(collections, "none", "x")
    with pytest.raises(ValueError):
        coll.describe(collections, "notes", "x" * 501)
