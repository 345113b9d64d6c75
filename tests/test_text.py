import html
import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as tx
from textquarry.functions.identity import basename, chunk_id, cite_key, existence_key, relative_path, row_chunk_id, suffix


def one(spark, column, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T</title></head><body><p>Hello <b>big</b> world</p><script>var x = '<p>';</script></body></html>", "Hello big world"),
        ("<nav>menu</nav><p> a </p><!-- <p>no</p> --><footer class='x'>f</footer>b<br/>c", "a b c"),
        ("x &lt;b&gt; &amp;amp; &eacute;&#233;&#xe9; &nope; 1 < 2", "x <b> &amp; ééé &nope; 1 < 2"),
        ("a<script>var x = '<!--';</script>b<!-- c -->d", "a b d"),
        ("a<nav>x<script>'</nav>'</script>y</nav>b<header>kept</header>", "a b kept"),
        ("a<style>p{} never closed <p>b</p>", "a"),
        ("<p>&nbsp;</p><P>Upper</P><STYLE>p{}</STYLE>", "Upper"),
        ("", ""),
    ],
)
def test_html_to_text(spark, page, text):
    assert one(spark, tx.html_to_text, page) == text


@pytest.mark.parametrize("text", ["&amp;lt;", "&copy;&hearts;&euro;", "&#65;&#x1F600;", "a & b", "&quot;&apos;&nbsp;", "&copy 2024"])
def test_entities_as_the_standard_library(spark, text):
    assert one(spark, tx.decode_entities, text) == html.unescape(text)


def test_html_metadata(spark):
    page = "<head><title> My &amp; Title </title><meta content=\"A. Writer\" name='author'></head>"
    assert one(spark, tx.html_title, page) == "My & Title"
    assert one(spark, tx.html_author, page) == "A. Writer"
    assert one(spark, tx.html_title, "<p>none</p>") == "" and one(spark, tx.html_author, "<p>none</p>") == ""


@pytest.mark.parametrize(
    "value, text",
    [
        ({"title": "T", "body": "B", "year": 2024}, "T B 2024"),
        ({"a": None, "b": [1, None, "x"], "c": {"d": True, "e": 1.5}}, "1  x True 1.5"),
        ("plain", "plain"),
        (None, ""),
        ([], ""),
    ],
)
def test_flatten_json(spark, value, text):
    assert one(spark, tx.flatten_json, json.dumps(value)) == text


def test_flatten_json_depth_and_errors(spark):
    for levels in (70, 1000):
        assert one(spark, tx.flatten_json, "[" * levels + '"x", 1' + "]" * levels) == "x 1"
    assert one(spark, tx.flatten_json, "{not json") is None


def test_invalid_bytes_are_dropped(spark):
    assert one(spark, tx.utf8_text, b"ok \xff\xfe caf\xc3\xa9", "binary") == "ok  café"


@pytest.mark.parametrize("value", [0.0, 1.0, 0.1, -2.5, 1e7, 12345678.9, 1e15, 123456789012345.6, 1e16, 1.5e300, 1e-3, 1e-4, 2.5e-5, 1e22, -1e7, 1e-300])
def test_doubles_print_in_plain_notation(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(tx.value_text(df, "v")).first()[0] == str(value)


def test_infinite_doubles(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(tx.value_text(df, "v")).collect()] == ["inf", "-inf", "nan"]


def test_row_text_skips_null_and_blank(spark):
    df = spark.createDataFrame([("A", None, " \u00a0", 3)], "name string, note string, blank string, n int")
    assert df.select(tx.row_text(df, df.columns)).first()[0] == "name: A | n: 3"


def test_template(spark):
    df = spark.createDataFrame([("T", None, 1)], "title string, content string, id int")
    filled = tx.template_text(df, "{title}: {content} {{{id}}}", df.columns)
    assert df.select(filled).first()[0] == "T:  {1}"
    with pytest.raises(ValueError, match="unknown column"):
        tx.template_text(df, "{missing}", df.columns)
    with pytest.raises(ValueError, match="format spec"):
        tx.template_text(df, "{id:03d}", df.columns)
    with pytest.raises(ValueError):
        tx.template_text(df, "x" * 5000, df.columns)


def test_created_at(spark):
    from datetime import datetime

    assert one(spark, tx.created_at, "2024-01-02T03:04:05+00:00") == datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, tx.created_at, "long ago") is None and one(spark, tx.created_at, "") is None


def test_names(spark):
    assert one(spark, suffix, "/a/b.TXT") == ".txt"
    assert one(spark, suffix, "/a.b/c") == "" and one(spark, suffix, "/a/.hidden") == ""
    assert one(spark, basename, r"C:\docs\a.txt") == "a.txt"
    assert one(spark, lambda c: cite_key(c, F.lit(2)), "/x/my report-1.v2.pdf") == "my_report_1_v2_2"
    assert one(spark, existence_key, "/db.sqlite::articles") == "/db.sqlite"
    assert one(spark, existence_key, "/plain.txt") == "/plain.txt"
    assert one(spark, lambda c: relative_path(c, "/root/docs/"), "/root/docs/a/b.txt") == "a/b.txt"
    assert one(spark, lambda c: relative_path(c, "/root/docs"), "/other/b.txt") == "/other/b.txt"


def test_ids_are_md5_of_their_parts(spark):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert one(spark, lambda c: chunk_id(c, F.lit(3)), "a/b.txt") == md5("a/b.txt::3")
    assert one(spark, lambda c: row_chunk_id(c, F.lit(7), F.lit(0)), "/d.db::t") == md5("sqlite::/d.db::t::7::0")


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p title='a > b'>hello</p>", "hello"),
        ("<nav>one<nav>two</nav>three</nav>four", "four"),
        ("a<footer>b<nav>c</footer>d", "a d"),
        ("a</nav>b<footer>never ends", "a b"),
        ("a<![CDATA[<p>x</p>]]>b<!-- <nav> -->c", "a b c"),
        ("<NAV class=\"x>y\">m</nav\n>t<navigation>u", "t u"),
        ("<script>'<nav>'</script>k<style>p>q{}</style>", "k"),
        ("x <a href=\"un'closed>y</a> z", "x y z"),
        ("\u0001\u0002q\u0003", "q"),
        ("<head><title>t</title></head><body>" + "<nav>m</nav>w " * 300, " ".join(["w"] * 300)),
    ],
)
def test_html_of_real_pages(spark, page, text):
    assert spark.createDataFrame([(page,)], "p string").select(tx.html_to_text(F.col("p"))).first()[0] == text


@pytest.mark.parametrize(
    "value, text",
    [({"a": [1, None, {"b": "x", "c": None}], "d": True}, "1  x True"), ([], ""), ({"a": {}, "b": 2}, " 2"), (None, ""), ([[["deep"]]], "deep")],
)
def test_scalars(value, text):
    assert tx.scalars(value) == text


def test_scalars_of_a_very_deep_value():
    value = "x"
    for _ in range(100_000):
        value = [value]
    assert tx.scalars(value) == "x"
    assert tx.scalars(value, max_depth=64) == "" and tx.scalars([[["x"]]], max_depth=3) == "x" and tx.scalars([[["x"]]], max_depth=2) == ""
