"""Text and metadata of office and e-book archives, read with the standard library inside Arrow batches."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARCHIVE = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "title", "author", "created", "error")])

# Namespaces of the document formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DUBLIN = "{http://purl.org/dc/elements/1.1/}"
TERMS = "{http://purl.org/dc/terms/}"
ODF_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
PACKAGE = "{http://www.idpf.org/2007/opf}"


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    rels = _xml(archive, f"{folder}/_rels/{name}.rels")
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") for r in rels}


def _runs(node: ElementTree.Element, space: str) -> str:
    """Text of a paragraph; tabs and breaks as the characters they stand for."""
    marks = {f"{space}t": None, f"{space}tab": "\t", f"{space}br": "\n", f"{space}cr": "\n"}
    return "".join((n.text or "") if marks[n.tag] is None else marks[n.tag] for n in node.iter() if n.tag in marks)


def _docx(archive: zipfile.ZipFile) -> str:
    body = _xml(archive, "word/document.xml").find(f"{WORD}body")
    texts = [_runs(p, WORD) for p in body.findall(f"{WORD}p")]
    return "\n".join(t for t in texts if t.strip())


def _pptx(archive: zipfile.ZipFile) -> str:
    targets = _relations(archive, "ppt/presentation.xml")
    slides = _xml(archive, "ppt/presentation.xml").iter(f"{SLIDE}sldId")
    texts = []
    for slide in slides:
        tree = _xml(archive, targets[slide.get(f"{RELATION}id")]).find(f".//{SLIDE}spTree")
        for shape in tree.findall(f"{SLIDE}sp"):
            texts.append("\n".join(_runs(p, DRAWING) for p in shape.iter(f"{DRAWING}p")).strip())
    return "\n".join(t for t in texts if t)


def _xlsx(archive: zipfile.ZipFile) -> str:
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in _xml(archive, "xl/sharedStrings.xml")]

    def cell(node):
        value = node.findtext(f"{SHEET}v")
        kind = node.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in node.iter(f"{SHEET}t"))
        if value is None:
            return None
        if kind == "s":
            return shared[int(value)]
        return {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value

    targets = _relations(archive, "xl/workbook.xml")
    rows = []
    for sheet in _xml(archive, "xl/workbook.xml").iter(f"{SHEET}sheet"):
        for row in _xml(archive, targets[sheet.get(f"{RELATION}id")]).iter(f"{SHEET}row"):
            rows.append(", ".join(v for v in map(cell, row.findall(f"{SHEET}c")) if v is not None))
    return "\n".join(r for r in rows if r.strip())


class _TextNodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []

    def handle_data(self, data):
        self.nodes.append(data.strip())


def _package(archive: zipfile.ZipFile) -> tuple[str, ElementTree.Element]:
    container = _xml(archive, "META-INF/container.xml")
    name = next(n.get("full-path") for n in container.iter() if n.tag.endswith("}rootfile"))
    return name, _xml(archive, name)


def _epub(archive: zipfile.ZipFile) -> str:
    name, package = _package(archive)
    texts = []
    for item in package.iter(f"{PACKAGE}item"):
        if item.get("media-type") != "application/xhtml+xml" or "nav" in (item.get("properties") or "").split():
            continue
        parser = _TextNodes()
        parser.feed(archive.read(posixpath.join(posixpath.dirname(name), item.get("href"))).decode("utf-8", "ignore"))
        parser.close()
        texts.append(" ".join(n for n in parser.nodes if n))
    return "\n".join(t for t in texts if t)


def _odt(archive: zipfile.ZipFile) -> str:
    """Only the text directly inside a paragraph: text of nested spans is not part of it."""
    texts = []
    for para in _xml(archive, "content.xml").iter(f"{ODF_TEXT}p"):
        texts.append((para.text or "") + "".join(child.tail or "" for child in para))
    return "\n".join(t for t in texts if t.strip())


def _first(root: ElementTree.Element, tag: str) -> str:
    return next((n.text or "" for n in root.iter(tag)), "")


def _office_metadata(archive: zipfile.ZipFile) -> tuple[str, str, str]:
    core = _xml(archive, "docProps/core.xml")
    created = re.sub(r"Z$", "+00:00", _first(core, f"{TERMS}created"))
    return _first(core, f"{DUBLIN}title"), _first(core, f"{DUBLIN}creator"), created


def _epub_metadata(archive: zipfile.ZipFile) -> tuple[str, str, str]:
    _, package = _package(archive)
    return tuple(_first(package, DUBLIN + n) for n in ("title", "creator", "date"))


def _odt_metadata(archive: zipfile.ZipFile) -> tuple[str, str, str]:
    meta = _xml(archive, "meta.xml")
    return tuple(_first(meta, DUBLIN + n) for n in ("title", "creator", "date"))


READERS = {
    ".docx": (_docx, _office_metadata),
    ".pptx": (_pptx, _office_metadata),
    ".xlsx": (_xlsx, None),
    ".epub": (_epub, _epub_metadata),
    ".odt": (_odt, _odt_metadata),
}


def _read(kind, content) -> tuple:
    """One archive. Unreadable text is an error of that file; unreadable metadata is blank."""
    text_of, metadata_of = READERS[kind]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            text = text_of(archive)
            try:
                title, author, created = metadata_of(archive) if metadata_of else ("", "", "")
            except Exception:
                title = author = created = ""
        return text, title, author, created, None
    except Exception as error:
        return None, "", "", "", f"{type(error).__name__}: {error}"


@F.pandas_udf(ARCHIVE)
def read_archives(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    """``text, title, author, created, error`` of each archive; nulls for other files."""
    rows = [_read(k, c) if k in READERS and c is not None else (None,) * 5 for k, c in zip(kind, content)]
    return pd.DataFrame(rows, columns=ARCHIVE.names)
