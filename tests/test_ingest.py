import pytest
from pyspark.sql import functions as F

from textquarry.errors import SourceNotFoundError, TableNotFoundError
from textquarry.functions.identity import row_hash
from textquarry.operators import changes as ch
from textquarry.operators import outcomes as oc
from textquarry.operators.ingest import (
    IngestOptions,
    ingest_files,
    ingest_folder,
    ingest_paths,
    ingest_table,
    known_files,
    known_rows,
)
from textquarry.schema import CHUNK, OUTCOME
from textquarry.sources.files import list_files
from textquarry.sources.tables import open_table

INCREMENTAL = IngestOptions(incremental=True)


def files(spark, **texts):
    rows = [(f"/docs/{name.replace('_', '.')}", bytearray(body.encode())) for name, body in texts.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def outcome(run):
    return {r["name"]: (r["status"], r["skip_reason"], r["n_chunks"]) for r in run.outcomes.collect()}


def test_folder_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("Content of A " * 20)
    (tmp_path / "sub" / "b.MD").write_text("Content of B " * 200)
    (tmp_path / "image.png").write_bytes(b"\x89PNG")
    (tmp_path / "empty.txt").write_text(" \n")
    (tmp_path / "bad.json").write_text("{no")
    run = ingest_folder(spark, str(tmp_path), "docs")
    assert outcome(run) == {
        "a.txt": ("ingested", None, 1),
        "b.MD": ("ingested", None, 4),
        "empty.txt": ("skipped", "empty", 0),
        "bad.json": ("error", "extract_error: invalid JSON", 0),
    }
    assert run.chunks.schema.simpleString() == CHUNK.simpleString()
    assert run.outcomes.schema.simpleString() == OUTCOME.simpleString()
    chunks = run.chunks.orderBy("source", "chunk").collect()
    assert [c["chunk"] for c in chunks] == [0, 0, 1, 2, 3]
    assert chunks[0]["source"] == str(tmp_path / "a.txt") and chunks[0]["source_type"] == "file"
    assert chunks[0]["file_hash"] and chunks[0]["doc_title"] == "" and len({c["id"] for c in chunks}) == 5
    assert [r["seq"] for r in run.outcomes.collect()] == sorted(r["seq"] for r in run.outcomes.collect())


def test_missing_folder(spark, tmp_path):
    with pytest.raises(SourceNotFoundError):
        list_files(spark, str(tmp_path / "none"))


def test_path_list(spark):
    listing = files(spark, a_txt="hello world " * 10, b_bin="x" * 90)
    requested = spark.createDataFrame([("/docs/a.txt",), ("/docs/b.bin",), ("/docs/c.txt",)], "path string")
    assert outcome(ingest_paths(requested, listing, "docs")) == {
        "a.txt": ("ingested", None, 1),
        "b.bin": ("skipped", "extract_error: unsupported format", 0),
        "c.txt": ("skipped", "extract_error: file not found", 0),
    }


def test_incremental_files(spark):
    first = files(spark, a_txt="alpha " * 20, b_txt="beta " * 600, c_txt="gamma " * 20, d_json='{"k": "' + "v" * 60 + '"}')
    stored = ingest_files(first, "docs").chunks
    second = files(spark, a_txt="alpha " * 20, b_txt="beta " * 20, c_txt="", d_json="{broken", e_txt="new " * 20)
    run = ingest_files(second, "docs", known_files(stored, "docs"), INCREMENTAL)
    assert outcome(run) == {
        "a.txt": ("skipped", "hash_match", 0),
        "b.txt": ("ingested", None, 1),
        "c.txt": ("skipped", "empty", 0),
        "d.json": ("error", "extract_error: invalid JSON", 0),
        "e.txt": ("ingested", None, 1),
    }
    after = run.apply(stored).groupBy("source").count()
    # b shrank from several chunks to one, c is gone, d could not be read and keeps its old chunk.
    assert {r["source"][-6:]: r["count"] for r in after.collect()} == {"/a.txt": 1, "/b.txt": 1, "d.json": 1, "/e.txt": 1}
    again = ingest_files(second, "docs", known_files(run.apply(stored), "docs"), INCREMENTAL)
    assert outcome(again)["b.txt"] == ("skipped", "hash_match", 0)


def test_other_collections_do_not_count(spark):
    stored = ingest_files(files(spark, a_txt="alpha " * 20), "other").chunks
    run = ingest_files(files(spark, a_txt="alpha " * 20), "docs", known_files(stored, "docs"), INCREMENTAL)
    assert outcome(run)["a.txt"][0] == "ingested"
    assert run.apply(stored).count() == 2


ARTICLES = [(1, "T1", "body word " * 30), (2, "T2", None), (3, None, None), (4, "T4", "w " * 900)]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ARTICLES, "id int, title string, body string")


def test_table_ingest(articles):
    run = ingest_table(articles, "/data/x.db::articles", "docs")
    assert outcome(run) == {
        "articles[1]": ("ingested", None, 1),
        "articles[2]": ("ingested", None, 1),
        "articles[3]": ("skipped", "empty_text", 0),
        "articles[4]": ("ingested", None, 3),
    }
    rows = {(c["row_id"], c["chunk"]): c for c in run.chunks.collect()}
    short = rows[("2", 0)]
    assert short["text"] == "title: T2" and short["source"] == "/data/x.db::articles" and short["source_type"] == "sqlite"
    assert short["n_chunks"] == 1 and rows[("4", 2)]["n_chunks"] == 3 and len(short["row_hash"]) == 16
    assert rows[("1", 0)]["text"].startswith("title: T1 | body: body word")


def test_table_columns_keep_the_row_key(articles):
    run = ingest_table(articles, "x::articles", "docs", columns=["title"])
    assert sorted(c["row_id"] for c in run.chunks.collect()) == ["1", "2", "4"]
    with pytest.raises(ValueError, match="columns not found"):
        ingest_table(articles, "x::articles", "docs", columns=["nope"])


def test_table_template(articles):
    run = ingest_table(articles, "x::articles", "docs", template="{id}/{title}: {body}")
    texts = {c["row_id"]: c["text"] for c in run.chunks.where("chunk = 0").collect()}
    assert texts["2"] == "2/T2: " and texts["3"] == "3/: "


def test_blank_template_text_is_kept(spark):
    df = spark.createDataFrame([(1, " ")], "id int, a string")
    assert [c["text"] for c in ingest_table(df, "x::t", "docs", template="{a}").chunks.collect()] == [" "]


def test_rows_without_id_are_all_kept(spark, monkeypatch):
    monkeypatch.setattr("textquarry.sources.tables.COPY_BLOCK", 3)
    rows = [("same", 1.0)] * 8 + [("other", 2.0), ("null", None)]
    df = spark.createDataFrame(rows, "name string, v double")
    first = ingest_table(df, "x::t", "docs").chunks.collect()
    assert len(first) == 10 and len({c["id"] for c in first}) == 10
    again = ingest_table(df.repartition(3), "x::t", "docs").chunks.collect()
    assert {c["id"] for c in first} == {c["id"] for c in again}


def test_incremental_rows(spark, articles):
    stored = ingest_table(articles, "x::articles", "docs").chunks
    changed = articles.withColumn("body", F.when(F.col("id") == 4, "short now").otherwise(F.col("body")))
    run = ingest_table(changed, "x::articles", "docs", known_rows(stored, "docs", "x::articles"), options=INCREMENTAL)
    assert {n: o[1] for n, o in outcome(run).items()} == {
        "articles[1]": "hash_match",
        "articles[2]": "hash_match",
        "articles[3]": "empty_text",
        "articles[4]": None,
    }
    after = run.apply(stored)
    assert after.where("row_id = '4'").count() == 1 and after.count() == 3


def test_missing_table(spark):
    with pytest.raises(TableNotFoundError):
        open_table(spark, "no_such_table")


def test_row_hash(spark):
    import hashlib

    got = spark.range(1).select(row_hash(F.lit("text"))).first()[0]
    assert got == hashlib.sha256(b"text").hexdigest()[:16]


def test_upsert_and_extra_ids(spark):
    stored = spark.createDataFrame([("c", "1", "old"), ("c", "2", "kept"), ("d", "1", "other")], "collection string, id string, text string")
    new = spark.createDataFrame([("c", "1", "new"), ("c", "3", "added")], "collection string, id string, text string")
    got = {(r["collection"], r["id"]): r["text"] for r in ch.upsert(stored, new).collect()}
    assert got == {("c", "1"): "new", ("c", "2"): "kept", ("c", "3"): "added", ("d", "1"): "other"}
    rows = spark.createDataFrame([("s", "7", 2)], "source string, row_id string, n_chunks int")
    predicted = ch.predicted_ids(rows, lambda s, r, c: F.concat_ws("-", s, r, c.cast("string")))
    ids = spark.createDataFrame([("s-7-0",), ("s-7-1",), ("s-7-2",)], "id string")
    assert [r["id"] for r in ch.extra_ids(ids, predicted).collect()] == ["s-7-2"]


def test_key_lists_leave_other_rows(spark):
    stored = spark.createDataFrame([(f"s{i % 4}", i) for i in range(40)], "source string, n int")
    gone = spark.createDataFrame([("s0",), ("s1",), ("s1",)], "source string")
    assert ch.without(stored, gone, ["source"]).count() == 20


def outcomes_of(spark, n):
    return spark.range(n).select(
        (F.col("id") * 3 + 1).alias("seq"),
        F.concat(F.lit("f"), "id").alias("name"),
        F.when(F.col("id") % 3 == 0, "ingested").otherwise("skipped").alias("status"),
        F.when(F.col("id") % 3 != 0, "empty").alias("skip_reason"),
        F.when(F.col("id") % 3 == 0, 2).otherwise(0).cast("int").alias("n_chunks"),
    )


def test_summary(spark):
    row = oc.ingest_summary(outcomes_of(spark, 10)).first()
    assert tuple(row) == (10, 4, 6, 8)
    assert tuple(oc.ingest_summary(outcomes_of(spark, 0)).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("n, listed, last", [(9, 6, "f8: empty"), (750, 500, "f749: empty"), (753, 501, "(truncated — more than 500 skipped entries)"), (0, 0, None)])
def test_skip_reasons_are_capped(spark, n, listed, last):
    got = oc.skip_reasons(outcomes_of(spark, n).repartition(4)).first()["skipped_reasons"]
    assert len(got) == listed and (got[-1] if got else None) == last


def test_skipped_rows_are_all_there(spark):
    got = oc.skipped_rows(outcomes_of(spark, 3000).repartition(4)).collect()
    assert len(got) == 2000 and {r["skip_reason"] for r in got} == {"empty"}
    assert oc.skipped_rows(outcomes_of(spark, 0)).count() == 0


@pytest.mark.parametrize("blocks", [2, 16])
def test_progress_is_a_running_total(spark, blocks):
    got = oc.ingest_progress(outcomes_of(spark, 500).repartition(7), blocks).orderBy("seq").collect()
    stored = 0
    for i, row in enumerate(got):
        stored += 2 if i % 3 == 0 else 0
        assert (row["files_done"], row["files_total"], row["chunks_stored"]) == (i + 1, 500, stored)


def test_running_total_over_text_order(spark):
    df = spark.createDataFrame([(f"{i:03d}", 1) for i in range(100)], "k string, v int").repartition(5)
    got = oc.running_totals(df, "k", {"total": "v"}, 8).orderBy("k").collect()
    assert [r["total"] for r in got] == list(range(1, 101))
