import os

import pytest

from textquarry.errors import CollectionExistsError, CollectionNotFoundError, SourceNotFoundError
from textquarry.library import TextLibrary
from textquarry.operators.ingest import IngestOptions
from textquarry.sources.files import stored_path


def test_life_of_a_collection(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "fox.txt").write_text("the quick brown fox jumps over the lazy dog again and again")
    (docs / "rain.md").write_text("rain falls mainly on the plain in the south of the country")
    (docs / "x.json").write_text("{")
    lib = TextLibrary(spark, str(tmp_path / "lib"))
    with pytest.raises(SourceNotFoundError):
        lib.ingest(str(tmp_path / "none"), "notes")
    assert lib.list_collections().count() == 0

    report = lib.ingest(str(docs), "notes").first()
    assert tuple(report) == (3, 2, 1, 2, ["x.json: extract_error: invalid JSON"])
    again = lib.ingest(str(docs), "notes", IngestOptions(incremental=True)).first()
    assert again["sources_ingested"] == 0 and "fox.txt: hash_match" in again["skipped_reasons"]

    rows = spark.createDataFrame([(1, "foxes"), (2, "weather report")], "id int, subject string")
    assert lib.ingest_table(rows, "db::mail", "mail").first()["chunks_stored"] == 2
    paths = spark.createDataFrame([(str(docs / "fox.txt"),), (str(docs / "gone.txt"),)], "path string")
    listed = lib.ingest_many(paths, str(docs), "picked").first()
    assert listed["sources_skipped"] == 1 and listed["skipped_reasons"] == ["gone.txt: extract_error: file not found"]

    hit = lib.query("quick fox", "notes", k=1).first()
    assert hit["source"] == str(docs / "fox.txt") and 0 < hit["score"] < 1 and hit["rank"] == 1
    merged = lib.query(["weather", "fox"], ["mail", "notes", "unknown"], k=2)
    assert {r["collection"] for r in merged.collect()} <= {"mail", "notes"} and merged.count() == 4
    only = lib.query("fox", ["mail", "notes"], where={"source_type": "sqlite"})
    assert {r["source"] for r in only.collect()} == {"db::mail"}
    assert "CONTEXT:\nthe quick" in lib.prompts("quick fox", "notes", k=1).first()["prompt"]
    with pytest.raises(CollectionNotFoundError):
        lib.query("x", "unknown")

    assert [tuple(r)[:3] for r in lib.stats().orderBy("name").collect()] == [("mail", 2, 1), ("notes", 2, 2), ("picked", 1, 1)]
    lib.describe("notes", "my notes")
    lib.rename("notes", "journal")
    with pytest.raises(CollectionExistsError):
        lib.rename("journal", "mail")
    assert tuple(lib.stats("journal").first()) == ("journal", 2, 2, "hashed-words-256", "my notes")
    assert lib.query("quick fox", "journal", k=1).first()["source"] == str(docs / "fox.txt")

    live = spark.createDataFrame([(str(docs / "fox.txt"),)], "source string")
    assert tuple(lib.purge("journal", live).first()) == (2, 1)
    assert [r["source"] for r in lib.sources("journal").collect()] == [str(docs / "fox.txt")]
    plain = lib.query("fox", "journal", k=1)
    filed = lib.query("fox", "journal", k=1, approximate=lib.train_index("journal"))
    assert filed.select("id", "score").collect() == plain.select("id", "score").collect() != []
    relative = os.path.relpath(docs / "fox.txt")
    gone = lib.delete_sources("journal", [relative, "/none"])
    assert {r["source"]: r["chunks_deleted"] for r in gone.collect()} == {relative: 1, "/none": 0}
    assert sorted(r["chunks_deleted"] for r in gone.collect()) == [0, 1]
    assert lib.source_counts("journal").count() == 0 and lib.query("fox", "journal").count() == 0

    with pytest.raises(ValueError):
        lib.reset("mail")
    lib.reset("mail", confirm=True)
    lib.reset("unknown", confirm=True)
    assert [r["name"] for r in lib.list_collections().collect()] == ["journal", "picked"]

    fresh = lib.compact(str(tmp_path / "fresh"))
    assert [r["name"] for r in fresh.list_collections().collect()] == ["journal", "picked"]
    assert fresh.chunks("picked").count() == lib.chunks("picked").count() == 1
    assert fresh.store.current().count() == 1  # the chunks of the dropped collection are not there
    with pytest.raises(ValueError):
        lib.request("fox", "picked", k=501)
    with pytest.raises(ValueError):
        lib.create("odd model", "/bad model")
    assert lib.request("fox", "picked", k=1).count() == 1


def test_watched_collection(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("alpha " * 20)
    lib = TextLibrary(spark, str(tmp_path / "lib"))
    lib.watch(str(docs), "seen", str(tmp_path / "log"), trigger={"availableNow": True}).awaitTermination()
    assert lib.stats("seen").first()["total_chunks"] == 1
    (docs / "a.txt").write_text("other " * 20)
    assert lib.reconcile(str(docs), "seen").first()["sources_ingested"] == 1
    assert lib.chunks("seen").first()["text"].startswith("other")


def test_paths_are_named_as_they_are_stored():
    assert stored_path("file:///a/b/../c.txt") == stored_path("file:/a/c.txt") == stored_path("/a/./c.txt") == "/a/c.txt"
    assert stored_path("c.txt") == os.path.join(os.getcwd(), "c.txt")
    assert stored_path("hdfs://x/c.txt") == "hdfs://x/c.txt" and stored_path("/db::t") == "/db::t"
