import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textquarry.operators.ingest import IngestOptions, ingest_files, ingest_table
from textquarry.sinks.store import ChunkStore
from textquarry.streaming.throttle import change_events, latest_windows, stamp_windows, throttle_windows, write_windows
from textquarry.streaming.watch import follow_folder, reconcile, watch_folder

T0 = datetime(2024, 1, 1)


def state(store, collection="docs"):
    rows = store.current(collection).groupBy("source").agg(F.count("*").alias("n"), F.first("text").alias("t")).collect()
    return {os.path.basename(r["source"]): (r["n"], r["t"][:5]) for r in rows}


def test_watched_folder(spark, tmp_path):
    folder, store = tmp_path / "docs", ChunkStore(spark, str(tmp_path / "store"))
    folder.mkdir()

    def watch():
        run = watch_folder(spark, str(folder), store, "docs", str(tmp_path / "log"), trigger={"availableNow": True})
        run.awaitTermination()

    (folder / "a.txt").write_text("alpha " * 300)
    (folder / "b.md").write_text("beta " * 20)
    (folder / "c.png").write_text("no")
    watch()
    assert state(store) == {"a.txt": (3, "alpha"), "b.md": (1, "beta ")}
    (folder / "d.txt").write_text("delta " * 20)
    watch()
    assert set(state(store)) == {"a.txt", "b.md", "d.txt"}

    # An edit and a deletion, which the stream does not see.
    (folder / "a.txt").write_text("again " * 20)
    (folder / "b.md").unlink()
    outcomes = {r["name"]: r["skip_reason"] for r in reconcile(spark, str(folder), store, "docs").collect()}
    assert outcomes == {"a.txt": None, "d.txt": "hash_match"}
    assert state(store) == {"a.txt": (1, "again"), "d.txt": (1, "delta")}
    compact = store.compact(str(tmp_path / "compact"))
    assert state(compact) == state(store)


def docs(spark, **texts):
    return spark.createDataFrame([(f"/d/{n}.txt", bytearray(t.encode())) for n, t in texts.items()], "path string, content binary")


def test_store_keeps_collections_and_rows_apart(spark, tmp_path):
    store, options = ChunkStore(spark, str(tmp_path / "s")), IngestOptions(incremental=True, materialize=True)
    store.append(ingest_files(docs(spark, a="alpha " * 20), "one", options=options))
    store.append(ingest_files(docs(spark, a="other " * 20), "two", options=options))
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    store.append(ingest_table(rows, "db::t", "one", options=options))
    store.append(ingest_table(rows.withColumn("v", F.lit("y")), "db::t", "one", store.known_rows("one", "db::t"), options=options))
    assert sorted((r["row_id"], r["text"]) for r in store.current("one").where("row_id is not null").collect()) == [("1", "v: y"), ("2", "v: y")]
    store.remove("one", spark.createDataFrame([("db::t",)], "source string"))
    assert store.current("one").count() == 1 and store.current().count() == 2
    # A removed source comes back when it is ingested again.
    store.append(ingest_table(rows, "db::t", "one", store.known_rows("one", "db::t"), options=options))
    assert store.current("one").count() == 3


@pytest.mark.parametrize("incremental", [True, False])
def test_null_and_repeated_row_ids(spark, tmp_path, incremental):
    """None is lost and none multiplied, also by a second equal ingest; of one id the greatest text stays."""
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n"), (None, "m"), (2, "c")], "id int, v string")
    store, options = ChunkStore(spark, str(tmp_path / "s")), IngestOptions(incremental=incremental, materialize=True)
    for n in range(2):
        run = ingest_table(rows, "db::t", "one", store.known_rows("one", "db::t"), options=options)
        store.append(run)
        assert [r["name"] for r in run.outcomes.orderBy("seq").collect()] == ["t[None]", "t[1]", "t[2]"]
        got = sorted((r["row_id"], r["text"]) for r in store.current("one").collect())
        assert got == [("1", "v: b"), ("2", "v: c"), ("None", "v: n")]


def test_unfinished_run_does_not_show(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.append(ingest_files(docs(spark, a="alpha " * 20), "docs"))
    write = store._append
    monkeypatch.setattr(store, "_append", lambda df, name: write(df, name) if name == "chunks" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.append(ingest_files(docs(spark, a="lost " * 20, b="lost " * 20), "docs"))
    monkeypatch.undo()
    assert state(store) == {"a.txt": (1, "alpha")}
    store.append(ingest_files(docs(spark, b="beta " * 20), "docs"))
    assert state(store) == {"a.txt": (1, "alpha"), "b.txt": (1, "beta ")}


def test_a_batch_that_runs_twice(spark, tmp_path):
    store, options = ChunkStore(spark, str(tmp_path / "s")), IngestOptions(incremental=True)
    for _ in range(2):
        store.append(ingest_files(docs(spark, a="alpha " * 20), "docs", store.known_files("docs"), options))
    assert store.current("docs").count() == 1


@pytest.fixture(scope="module")
def changes(spark):
    rows = [("f", "a", 0.0), ("f", "b", 1.0), ("f", "a", 1.5), ("f", "c", 5.0), ("g", "x", 0.2), ("f", "d", 30.0), ("g", "z", 60.0)]
    return spark.createDataFrame([(f, p, T0 + timedelta(seconds=s)) for f, p, s in rows], "folder string, path string, ts timestamp")


def test_throttle_windows(changes):
    got = {(r["folder"], r["emitted_at"]): (r["changes"], r["paths"]) for r in throttle_windows(changes).collect()}
    assert got[("f", T0 + timedelta(seconds=3))] == (3, 2) and len(got) == 5
    assert stamp_windows(changes).count() == 7
    lists = {(r["folder"], r["emitted_at"]): r["paths"] for r in change_events(changes, parts=1).collect()}
    assert lists[("f", T0 + timedelta(seconds=3))] == ["a", "b", "a"]
    parts = change_events(changes, parts=4).collect()
    assert sum(len(r["paths"]) for r in parts) == 7


def test_streamed_windows_are_complete(spark, changes, tmp_path):
    """Changes come in three micro-batches; windows that the watermark leaves open are there too."""
    for i, (low, high) in enumerate([(0, 1.2), (1.2, 6), (6, 100)]):
        part = changes.where((F.col("ts") >= T0 + timedelta(seconds=low)) & (F.col("ts") < T0 + timedelta(seconds=high)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    write_windows(throttle_windows(stream), out, str(tmp_path / "log"), {"availableNow": True}).awaitTermination()
    got = latest_windows(spark.read.parquet(out)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, throttle_windows(changes).collect()))


def test_followed_folder(spark, tmp_path):
    folder, store = tmp_path / "docs", ChunkStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    (folder / "a.txt").write_text("alpha " * 20)
    (folder / "b.txt").write_text("beta " * 20)

    def until(want):
        for _ in range(120):
            if state(store) == want:
                return True
            time.sleep(0.5)
        return state(store)

    run = follow_folder(spark, str(folder), store, "docs", str(tmp_path / "log"), "1 second")
    try:
        assert until({"a.txt": (1, "alpha"), "b.txt": (1, "beta ")}) is True
        (folder / "a.txt").write_text("other " * 20)
        (folder / "b.txt").unlink()
        assert until({"a.txt": (1, "other")}) is True
    finally:
        run.stop()
