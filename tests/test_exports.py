import json
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from textquarry.sinks import exports as ex

HITS = [
    (7, 1, "alpha {beta}\nsecond  line", "/docs/my report.v1.pdf", "file", 0.9, 0, 'what "is" {this}?'),
    (7, 2, 'x "quoted"', "/data/shop.db::orders", "sqlite", 0.1235, 3, 'what "is" {this}?'),
]


@pytest.fixture(scope="module")
def hits(spark):
    schema = "qid long, rank int, text string, source string, source_type string, score double, chunk int, query_text string"
    return spark.createDataFrame(HITS, schema).repartition(2)


def content(df):
    return df.first()["content"]


def test_scores_round_by_their_exact_value(spark):
    scores = [i / 10000 for i in range(10001)]
    got = spark.createDataFrame([(s,) for s in scores], "s double").select("s", ex.fixed3(F.col("s")).alias("t")).collect()
    for row in got:
        assert row["t"] == str(Decimal(row["s"]).quantize(Decimal("0.001"), ROUND_HALF_UP))


def test_csv(hits):
    assert content(ex.to_csv(hits)).split("\n") == [
        "score,source,chunk,text",
        '0.9,"/docs/my report.v1.pdf",0,"alpha {beta} second  line"',
        '0.1235,"/data/shop.db::orders",3,"x ""quoted"""',
    ]
    one = hits.withColumn("score", F.lit(1.0))
    assert content(ex.to_csv(one)).split("\n")[1].startswith("1,")


def test_json(hits):
    got = json.loads(content(ex.to_json(hits)))
    assert [h["source"] for h in got] == [HITS[0][3], HITS[1][3]] and got[1]["score"] == 0.1235


def test_markdown(hits):
    assert content(ex.to_markdown(hits)) == (
        '# Query Results\n\n**Query:** what "is" {this}?\n\n'
        "## 1. my report.v1.pdf (score: 0.900)\n\nalpha {beta}\nsecond  line\n"
        "\n---\n\n"
        '## 2. shop.db::orders (score: 0.123)\n\nx "quoted"\n'
    )


def test_bibtex(hits):
    got = content(ex.to_bibtex(hits, 2024))
    assert got.count("@misc{") == 2 and "@misc{my_report_v1_0," in got and "@misc{shop_1," in got
    assert "annotation  = {alpha beta second line}" in got and "Query: what \"is\" this?" in got and "year        = {2024}" in got


def test_ris(hits):
    first, second = content(ex.to_ris(hits, 2024)).split("\n\n")
    assert first.startswith("TY  - GEN\nTI  - my report.v1.pdf\nAB  - alpha {beta} second  line\n") and first.endswith("ER  - ")
    assert "\nUR  - /docs/my report.v1.pdf\n" in first and "UR  -" not in second
    assert "\nN1  - SQLite source: /data/shop.db::orders\n" in second


def test_csl(hits):
    got = json.loads(content(ex.to_csl_json(hits, 2024)))
    assert [i["id"] for i in got] == ["my_report_v1_0", "shop_1"]
    assert got[0]["issued"] == {"date-parts": [[2024]]} and got[0]["type"] == "document"


def test_long_texts_are_cut_where_the_format_says(hits):
    long = hits.withColumn("text", F.repeat(F.lit("y"), 3000))
    assert "annotation  = {" + "y" * 500 + "}" in content(ex.to_bibtex(long, 2024))
    assert "AB  - " + "y" * 2000 + "\n" in content(ex.to_ris(long, 2024))
    assert "annotation  = {" + "y" * 3000 + "}" in content(ex.to_bibtex(long, 2024, note_chars=None))
    assert "AB  - " + "y" * 3000 + "\n" in content(ex.to_ris(long, 2024, abstract_chars=None))
    assert "y" * 3000 in content(ex.to_csl_json(long, 2024, abstract_chars=None))


def test_vault(hits):
    rows = {r["path"]: r["content"] for r in ex.to_vault(hits, "2024-06-30").collect()}
    folder = "Search — what _is_ {this}_ — 2024-06-30 (7)/"
    assert set(rows) == {folder + n for n in ("README.md", "my_report_v1_0.md", "shop_1.md")}
    assert rows[folder + "README.md"].endswith("## Results\n- [[my_report_v1_0]] — /docs/my report.v1.pdf\n- [[shop_1]] — /data/shop.db::orders")
    note = rows[folder + "shop_1.md"].split("\n")
    assert note[:6] == ["---", 'source: "/data/shop.db::orders"', "score: 0.123", "chunk: 3", 'query: "what \\"is\\" {this}?"', "---"]


def test_answer(spark, hits):
    answers = spark.createDataFrame([(7, "Forty-two.", "local", "none")], "qid long, answer string, provider string, model string")
    got = content(ex.to_answer_markdown(answers, hits))
    assert got.startswith('# Answer\n\n**Query:** what "is" {this}?\n**Provider:** local · none\n\n## Answer\n\nForty-two.\n\n## Sources\n\n### 1.')
    assert got.count("\n\n---\n\n") == 1


def test_written_documents(spark, hits, tmp_path):
    ex.write_documents(ex.to_markdown(hits), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).where("qid = 7").first()["value"].startswith("# Query Results")
    ex.write_hits(hits, str(tmp_path / "hits"))
    assert spark.read.json(str(tmp_path / "hits")).count() == 2
