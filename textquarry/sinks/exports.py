"""Hits as JSON, CSV, Markdown, BibTeX, RIS, CSL-JSON and a vault of notes.

One function formats one hit as a Column; a document is the hits of one query in rank order, so a group holds at most
the number of results. ``hits`` has ``qid, rank, text, source, source_type, score, chunk`` and ``query_text``. Years
and dates are parameters: the output depends on its input alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.identity import basename, cite_key
from textquarry.operators.hits import ordered_join
from textquarry.session import materialize

# Fixed values of the formats.
NOTE_CHARS = 500
ABSTRACT_CHARS = 2000
VAULT_NAME_CHARS = 80
TABLE_SOURCE = "sqlite"


def fixed3(score: Column) -> Column:
    """A score of four decimals with three, by the exact value of the double and upwards on a true tie.

    ``%.3f`` would round the printed decimals, which turns 0.1235 (stored slightly below) into 0.124.
    """
    n = F.round(score * 10000).cast("long")
    high = F.floor(score * (1 << 26)) / (1 << 26)
    error = (high * 10000 - n) + (score - high) * 10000
    up = (n % 10 > 5) | ((n % 10 == 5) & (error >= 0))
    mills = F.floor(n / 10) + up.cast("long")
    return F.concat(
        F.floor(mills / 1000).cast("string"), F.lit("."), F.lpad((mills % 1000).cast("string"), 3, "0")
    )


def plain_score(score: Column) -> Column:
    """A score without trailing zeros: ``0.5``, ``1``, ``0.0001``."""
    return F.regexp_replace(score.cast("decimal(9,4)").cast("string"), r"\.?0+$", "")


def _title(source: Column) -> Column:
    return basename(source)


def _index() -> Column:
    return F.col("rank") - 1


def _one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def _document(hits: DataFrame, entry: Column, separator: str) -> DataFrame:
    """``qid, query_text, content``: entries of a query joined in rank order."""
    return hits.groupBy("qid", "query_text").agg(ordered_join(entry, F.col("rank"), separator).alias("content"))


def csv_line(source: Column, text: Column, score: Column, chunk: Column) -> Column:
    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))

    return F.concat_ws(",", plain_score(score), quoted(source), chunk.cast("string"), quoted(_one_line(text)))


def to_csv(hits: DataFrame) -> DataFrame:
    """Header and one line per hit; source and text are always quoted."""
    line = csv_line(F.col("source"), F.col("text"), F.col("score"), F.col("chunk"))
    doc = _document(hits, line, "\n")
    return doc.withColumn("content", F.concat(F.lit("score,source,chunk,text\n"), "content"))


def to_json(hits: DataFrame) -> DataFrame:
    """An array of the hits of each query in rank order."""
    fields = ["text", "source", "source_type", "score", "distance", "chunk", "doc_title", "doc_author", "doc_created"]
    present = [f for f in fields if f in hits.columns]
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.struct(*present).alias("hit"))))
    return hits.groupBy("qid", "query_text").agg(F.to_json(F.transform(ranked, lambda r: r["hit"])).alias("content"))


def to_markdown(hits: DataFrame) -> DataFrame:
    entry = F.concat(
        F.lit("## "),
        F.col("rank").cast("string"),
        F.lit(". "),
        _title(F.col("source")),
        F.lit(" (score: "),
        fixed3(F.col("score")),
        F.lit(")\n\n"),
        F.col("text"),
        F.lit("\n"),
    )
    head = F.concat(F.lit("# Query Results\n\n**Query:** "), F.col("query_text"), F.lit("\n\n"))
    return _document(hits, entry, "\n---\n\n").withColumn("content", F.concat(head, "content"))


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def bibtex_entry(year: int, note_chars: int | None = NOTE_CHARS) -> Column:
    def no_braces(value: Column) -> Column:
        return F.regexp_replace(value, "[{}]", "")

    note = _cut(F.regexp_replace(no_braces(F.col("text")), r"(?U)\s+", " "), note_chars)
    return F.concat(
        F.lit("@misc{"),
        cite_key(F.col("source"), _index()),
        F.lit(",\n  title       = {"),
        _title(F.col("source")),
        F.lit("},\n  note        = {Score: "),
        fixed3(F.col("score")),
        F.lit("; Query: "),
        no_braces(F.col("query_text")),
        F.lit("},\n  annotation  = {"),
        note,
        F.lit(f"}},\n  year        = {{{year}}}\n}}"),
    )


def to_bibtex(hits: DataFrame, year: int, note_chars: int | None = NOTE_CHARS) -> DataFrame:
    """``note_chars``: how much of a text the annotation holds; all of it if None."""
    return _document(hits, bibtex_entry(year, note_chars), "\n\n")


def ris_entry(year: int, abstract_chars: int | None = ABSTRACT_CHARS) -> Column:
    source = F.col("source")
    where = F.when(
        F.col("source_type") == TABLE_SOURCE, F.concat(F.lit("N1  - SQLite source: "), source)
    ).otherwise(F.concat(F.lit("UR  - "), source))
    return F.concat_ws(
        "\n",
        F.lit("TY  - GEN"),
        F.concat(F.lit("TI  - "), _title(source)),
        F.concat(F.lit("AB  - "), _cut(_one_line(F.col("text")), abstract_chars)),
        F.concat(
            F.lit("N1  - Semantic search; score "),
            fixed3(F.col("score")),
            F.lit('; query "'),
            _one_line(F.col("query_text")),
            F.lit('"'),
        ),
        F.lit(f"PY  - {year}"),
        where,
        F.lit("ER  - "),
    )


def to_ris(hits: DataFrame, year: int, abstract_chars: int | None = ABSTRACT_CHARS) -> DataFrame:
    """``abstract_chars``: how much of a text the abstract holds; all of it if None."""
    return _document(hits, ris_entry(year, abstract_chars), "\n\n")


def csl_item(year: int, abstract_chars: int | None = ABSTRACT_CHARS) -> Column:
    return F.struct(
        cite_key(F.col("source"), _index()).alias("id"),
        F.lit("document").alias("type"),
        _title(F.col("source")).alias("title"),
        _cut(F.col("text"), abstract_chars).alias("abstract"),
        F.concat(F.lit("score="), fixed3(F.col("score")), F.lit("; query="), F.col("query_text")).alias("note"),
        F.struct(F.array(F.array(F.lit(year))).alias("date-parts")).alias("issued"),
        F.col("source").alias("URL"),
    )


def to_csl_json(hits: DataFrame, year: int, abstract_chars: int | None = ABSTRACT_CHARS) -> DataFrame:
    """``abstract_chars``: how much of a text the abstract holds; all of it if None."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.to_json(csl_item(year, abstract_chars)).alias("item"))))
    items = F.array_join(F.transform(ranked, lambda r: r["item"]), ",")
    return hits.groupBy("qid", "query_text").agg(F.concat(F.lit("["), items, F.lit("]")).alias("content"))


def to_vault(hits: DataFrame, date: str) -> DataFrame:
    """``qid, path, content``: an index note per query and one note with front matter per hit.

    The hits are used twice, so they are written first.
    """
    hits = materialize(hits)
    safe = F.substring(F.regexp_replace(F.col("query_text"), r'[\\/:*?"<>|]+', "_"), 1, VAULT_NAME_CHARS)
    # Queries may agree in the characters shown; their ids keep their notes apart.
    folder = F.concat(F.lit("Search — "), safe, F.lit(f" — {date} ("), F.col("qid").cast("string"), F.lit(")/"))
    key = cite_key(F.col("source"), _index())

    def yaml(value: Column) -> Column:
        return _one_line(F.replace(value, F.lit('"'), F.lit('\\"')))

    notes = hits.select(
        "qid",
        F.concat(folder, key, F.lit(".md")).alias("path"),
        F.concat(
            F.lit('---\nsource: "'),
            yaml(F.col("source")),
            F.lit('"\nscore: '),
            fixed3(F.col("score")),
            F.lit("\nchunk: "),
            F.coalesce(F.col("chunk").cast("string"), F.lit("")),
            F.lit('\nquery: "'),
            yaml(F.col("query_text")),
            F.lit('"\n---\n\n'),
            F.col("text"),
        ).alias("content"),
    )
    entry = F.concat(F.lit("- [["), key, F.lit("]] — "), F.col("source"))
    index = _document(hits, entry, "\n").select(
        "qid",
        F.concat(folder, F.lit("README.md")).alias("path"),
        F.concat(F.lit("# "), safe, F.lit(f"\n\nExported on {date}.\n\n## Results\n"), F.col("content")).alias("content"),
    )
    return index.unionByName(notes)


def to_answer_markdown(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """An answer with its ranked sources. ``answers`` has ``qid, answer, provider, model``."""
    entry = F.concat(
        F.lit("### "),
        F.col("rank").cast("string"),
        F.lit(". "),
        _title(F.col("source")),
        F.lit(" (score: "),
        fixed3(F.col("score")),
        F.lit(")\n\n"),
        F.col("text"),
    )
    listed = _document(hits, entry, "\n\n---\n\n").join(answers, "qid")
    return listed.select(
        "qid",
        "query_text",
        F.concat(
            F.lit("# Answer\n\n**Query:** "),
            "query_text",
            F.lit("\n**Provider:** "),
            "provider",
            F.lit(" · "),
            "model",
            F.lit("\n\n## Answer\n\n"),
            "answer",
            F.lit("\n\n## Sources\n\n"),
            "content",
        ).alias("content"),
    )


def write_documents(documents: DataFrame, folder: str) -> None:
    """One text document per query below ``folder``, in a directory per query."""
    documents.select("qid", "content").write.mode("overwrite").partitionBy("qid").option("lineSep", "\n").text(folder)


def write_hits(hits: DataFrame, folder: str, fmt: str = "json") -> None:
    """Hits as they are, one row each, in one of Spark's file formats."""
    hits.write.mode("overwrite").format(fmt).save(folder)
