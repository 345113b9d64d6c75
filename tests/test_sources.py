import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from textquarry.sources import files
from textquarry.sources.files import SUPPORTED_SUFFIXES, extract_files, is_supported, list_files, scan_files
from textquarry.sources.records import scan_csv_records, scan_json_lines

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
CORE = (
    '<cp:coreProperties xmlns:cp="c" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">'
    "<dc:title>The Title</dc:title><dc:creator>A. Writer</dc:creator><dcterms:created>2024-01-02T03:04:05Z</dcterms:created>"
    "</cp:coreProperties>"
)


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return bytearray(out.getvalue())


def rels(**targets):
    inner = "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

DOCX = {
    "word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>docx</w:t></w:r></w:p><w:p/>"
    "<w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>",
    "docProps/core.xml": CORE,
}
PPTX = {
    "ppt/presentation.xml": f'<p:presentation {P} xmlns:r="{REL}"><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": rels(r1="slides/slide1.xml", r2="slides/slide2.xml"),
    "ppt/slides/slide1.xml": f"<p:sld {P} {A}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t> Last </a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>",
    "ppt/slides/slide2.xml": f"<p:sld {P} {A}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>First</a:t></a:r></a:p><a:p><a:r><a:t>line two</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>",
}
XLSX = {
    "xl/workbook.xml": f'<workbook {S} xmlns:r="{REL}"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": rels(r1="worksheets/sheet1.xml"),
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Name</t></si><si><t>Score</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row>'
    '<row><c t="inlineStr"><is><t>Alice</t></is></c><c/><c><v>95</v></c><c t="b"><v>1</v></c></row><row><c/></row></sheetData></worksheet>',
}
EPUB = {
    "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/c.opf"/></rootfiles></container>',
    "OPS/c.opf": '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Book</dc:title><dc:creator>B</dc:creator><dc:date>2020</dc:date></metadata>'
    '<manifest><item id="a" href="ch1.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="x.css" media-type="text/css"/></manifest></package>',
    "OPS/ch1.xhtml": "<html><body><h1>Chapter</h1><p>One &amp; only</p></body></html>",
    "OPS/nav.xhtml": "<html><body>menu</body></html>",
}
ODT = {
    "content.xml": '<office:document-content xmlns:office="o" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:p>Plain <text:span>span</text:span>tail</text:p><text:p> </text:p></office:document-content>',
    "meta.xml": '<office:document-meta xmlns:office="o" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Doc</dc:title><dc:creator>C</dc:creator><dc:date>2021-01-01</dc:date></office:document-meta>',
}

CASES = {
    "/f/a.txt": (b"caf\xc3\xa9 \xff!", "café !", ("", "", "")),
    "/f/b.MD": (b"# head", "# head", ("", "", "")),
    "/f/c.csv": (b'name,age\nAlice,30\n"Bo, b",25\n', "name, age\nAlice, 30\nBo, b, 25", ("", "", "")),
    "/f/d.json": (b'{"title": "T", "body": "B", "year": 2024}', "T B 2024", ("", "", "")),
    "/f/e.jsonl": (b'{"text": "one"}\n\nbroken\n{"text": "two"}\n', "one\ntwo", ("", "", "")),
    "/f/g.html": (
        b"<html><head><title>T</title><meta name='author' content='A'></head><body><p>Hi</p><script>x</script></body></html>",
        "Hi",
        ("T", "A", ""),
    ),
    "/f/h.docx": (packed(DOCX), "Hello\tdocx\nSecond", ("The Title", "A. Writer", "2024-01-02T03:04:05+00:00")),
    "/f/i.pptx": (packed(PPTX), "First\nline two\nLast", ("", "", "")),
    "/f/j.xlsx": (packed(XLSX), "Name, Score\nAlice, 95, True", ("", "", "")),
    "/f/k.epub": (packed(EPUB), "Chapter One & only", ("Book", "B", "2020")),
    "/f/l.odt": (packed(ODT), "Plain tail", ("Doc", "C", "2021-01-01")),
}


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(path, bytearray(body)) for path, (body, _, _) in CASES.items()]
    rows += [("/f/bad.docx", bytearray(b"no zip")), ("/f/bad.json", bytearray(b"{")), ("/f/x.pdf", bytearray(b"%PDF")), ("/f/gone.txt", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    return {r["path"]: r for r in extract_files(df).collect()}


@pytest.mark.parametrize("path", CASES)
def test_every_format(extracted, path):
    _, text, metadata = CASES[path]
    row = extracted[path]
    assert (row["error"], row["text"]) == (None, text)
    assert (row["doc_title"], row["doc_author"], row["doc_created"]) == metadata


def test_errors_stay_with_their_file(extracted):
    assert extracted["/f/bad.docx"]["error"].startswith("BadZipFile")
    assert extracted["/f/bad.json"]["error"] == "invalid JSON"
    assert extracted["/f/x.pdf"]["error"] == "unsupported format"
    assert extracted["/f/gone.txt"]["error"] == "file not found"


def test_unreadable_metadata_is_blank(spark):
    body = packed({**DOCX, "docProps/core.xml": "<broken"})
    row = extract_files(spark.createDataFrame([("a.docx", body)], "path string, content binary")).first()
    assert row["error"] is None and row["doc_title"] == "" and row["text"] == "Hello\tdocx\nSecond"


def test_scan_keeps_supported_suffixes(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name in ("a.txt", "deep/b.HTML", "deep/er/c.Md", "d.png", "noext"):
        (tmp_path / name).write_text("x")
    assert {r["path"] for r in scan_files(spark, str(tmp_path)).select("path").collect()} == {
        str(tmp_path / n) for n in ("a.txt", "deep/b.HTML", "deep/er/c.Md")
    }
    plan = list_files(spark, str(tmp_path)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    names = spark.createDataFrame([(f"x{s.upper()}",) for s in SUPPORTED_SUFFIXES], "p string")
    assert names.where(is_supported(F.col("p"))).count() == len(SUPPORTED_SUFFIXES)


def test_record_scans(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": "x", "b": {"c": 1}}\n\nnope\n  {"a": true}  \n')
    assert [r["text"] for r in scan_json_lines(spark, str(tmp_path / "r.jsonl")).collect()] == ["x 1", "True"]
    (tmp_path / "r.csv").write_text('name,age\nAlice,30\n"B, ""b""",\n')
    assert [r["text"] for r in scan_csv_records(spark, str(tmp_path / "r.csv")).collect()] == ["name, age", "Alice, 30", 'B, "b", ']


def test_ragged_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text('1,2,3,4,5\n1,2\n\n"a,b",c\n' + "x" * 200_000 + ",y\n")
    got = [r["text"] for r in scan_csv_records(spark, str(tmp_path / "r.csv")).collect()]
    assert got == ["1, 2, 3, 4, 5", "1, 2", "", "a,b, c", "x" * 200_000 + ", y"]


def test_hard_files_end_no_job(spark):
    deep = "[" * 200_000
    rows = [("/a.csv", b'"' + b"z" * 200_000), ("/b.jsonl", f'{deep}\n{{"a": "ok"}}'.encode()), ("/c.json", deep.encode())]
    got = {r["path"]: r for r in extract_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["/a.csv"]["text"] == "z" * 200_000 and got["/a.csv"]["error"] is None
    assert (got["/b.jsonl"]["text"], got["/b.jsonl"]["error"]) == ("ok", None)
    assert got["/c.json"]["error"] == "invalid JSON"


def test_registered_extractor(spark, monkeypatch):
    monkeypatch.setattr(files, "EXTRACTORS", {})

    def backwards(content):
        text = F.reverse(content.cast("string"))
        fields = {"text": text, "title": F.lit("T"), "author": F.lit(""), "created": F.lit(""), "error": F.when(text == "", "nothing")}
        return F.struct(*[c.cast("string").alias(n) for n, c in fields.items()])

    files.register_extractor(backwards, ".rev", ".TXT")
    df = spark.createDataFrame([("/a.rev", b"abc"), ("/b.txt", b"xy"), ("/c.md", b"md"), ("/d.rev", b"")], "path string, content binary")
    got = {r["path"]: (r["text"], r["doc_title"], r["error"]) for r in extract_files(df).collect()}
    assert got == {"/a.rev": ("cba", "T", None), "/b.txt": ("yx", "T", None), "/c.md": ("md", "", None), "/d.rev": ("", "T", "nothing")}
    assert df.where(files.is_supported(F.col("path"))).count() == 4


def test_paths_are_read_by_request_alone(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.bin"):
        (tmp_path / name).write_text(name)
    wanted = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.txt", "c.bin", "gone.txt")], "path string")
    got = {os.path.basename(r["path"]): (r["skip_reason"], r["content"] and bytes(r["content"])) for r in files.scan_paths(wanted, list_files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": (None, b"a.txt"), "c.bin": ("extract_error: unsupported format", None), "gone.txt": ("extract_error: file not found", None)}


def test_rows_without_copies_meet_no_table_of_copies(spark):
    from textquarry.sources.tables import ROW_ID, scan_table

    table = spark.range(500).select(F.col("id").alias("n"), (F.col("id") % 7).alias("m"))
    rows = scan_table(table).rows
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.select(ROW_ID).distinct().count() == 500
    twice = scan_table(table.unionByName(table.where("m = 3")).unionByName(table.where("n < 2"))).rows
    ids = sorted(r[0] for r in twice.select(ROW_ID).collect())
    plain = {r[0] for r in rows.select(ROW_ID).collect()}
    assert len(set(ids)) == len(ids) == 500 + 71 + 2
    assert {i.split("#")[0] for i in ids} == plain and sum(i.endswith("#1") for i in ids) == 73
