"""Text functions: whitespace, sentences, HTML, JSON and row serialisation."""

from __future__ import annotations

import html.entities
import json
import math
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode white space plus the four ASCII separators that also count as blank.
BLANK = r"[\s\x1c-\x1f]"


def normalize_whitespace(text: Column) -> Column:
    """Every run of white space becomes one space; none is left at the ends."""
    return F.btrim(F.regexp_replace(text, f"(?U){BLANK}+", " "))


def strip(text: Column) -> Column:
    """Drop white space (Unicode included) at both ends."""
    return F.regexp_replace(text, f"(?U)^{BLANK}+|{BLANK}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"(?U)[^\\s\\x1c-\\x1f]")


def utf8_text(content: Column) -> Column:
    """Bytes to text; bytes that are not valid UTF-8 are dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def sentences(text: Column) -> Column:
    """Paragraphs on blank lines, then a break after ``.``, ``!`` or ``?`` and white space."""
    paragraphs = F.split(text, f"(?U)\\n\\s*\\n")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.split(strip(p), f"(?U)(?<=[.!?]){BLANK}+")))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


# --- HTML ---------------------------------------------------------------------------------------------------------

# Elements whose whole content is not text of the page. Inside the first two, markup is not markup.
RAW_ELEMENTS = ("script", "style")
DROPPED_ELEMENTS = ("nav", "footer", "head")

_NODE = "\u0001"
_ENTITY = r"&(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]*;?)"


# Tried before the full table, which Spark searches entry by entry; the ampersand is last.
COMMON_ENTITIES = ("lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "middot;", "ndash;", "mdash;", "hellip;", "amp;")


def _named_entity(name: Column) -> Column:
    """A standard named entity, as written after the ampersand; null if there is no such name."""

    def table(entities: dict[str, str]) -> Column:
        return F.from_json(F.lit(json.dumps(entities)), T.MapType(T.StringType(), T.StringType()))

    common = {n: html.entities.html5[n] for n in COMMON_ENTITIES}
    return F.coalesce(
        F.try_element_at(table(common), name), F.try_element_at(table(html.entities.html5), name)
    )


def decode_entities(text: Column) -> Column:
    """Replace character references in one pass, so that ``&amp;lt;`` gives ``&lt;``."""

    def one(ref: Column) -> Column:
        name = F.substring(ref, 2, 64)
        number = F.when(
            name.rlike("^#[xX]"), F.conv(F.regexp_extract(name, "^#[xX]([0-9a-fA-F]+)", 1), 16, 10)
        ).otherwise(F.regexp_extract(name, "^#([0-9]+)", 1))
        code = number.try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (
            F.when(name.startswith("#") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char)
            .when(name.startswith("#"), F.lit("�"))
            .otherwise(F.coalesce(_named_entity(name), ref))
        )

    literal = F.split(text, _ENTITY)
    refs = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    joined = F.zip_with(literal, refs, lambda a, b: F.concat(a, F.coalesce(one(b), F.lit(""))))
    # Most texts have none but common references. Replaced one by one, the ampersand last, they need no splitting.
    simple = text
    for name in COMMON_ENTITIES:
        simple = F.replace(simple, F.lit(f"&{name}"), F.lit(html.entities.html5[name]))
    rare = rf"&(?!(?:{'|'.join(COMMON_ENTITIES)}))(?:#|[A-Za-z])"
    return (
        F.when(~text.contains("&"), text).when(~text.rlike(rare), simple).otherwise(F.array_join(joined, ""))
    )


# A tag with its attributes; a ">" within quotes does not end it, unless the quotes never close.
_TAG = r"""<[/!?]?[A-Za-z](?:(?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>)"""
_OPEN, _CLOSE = "\u0002", "\u0003"


def _outside_dropped(marked: Column) -> Column:
    """Text outside of dropped elements. ``marked`` has each of their tags as a mark and the element's number.

    The text is cut at the marks and folded with the stack of open elements: an end tag closes the innermost element of
    its name and all in it, one without a start tag is passed over, and an element that never ends holds the rest.
    """
    pieces = F.split(marked, f"(?=[{_OPEN}{_CLOSE}])", -1)
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        name = F.substring(piece, 2, 1)
        opening, closing = F.startswith(piece, F.lit(_OPEN)), F.startswith(piece, F.lit(_CLOSE))
        popped = F.regexp_replace(state["open"], F.concat(name, F.lit("[^"), name, F.lit("]*$")), F.lit(""))
        stack = (
            F.when(opening, F.concat(state["open"], name))
            .when(closing & F.contains(state["open"], name), popped)
            .otherwise(state["open"])
        )
        return F.struct(stack.alias("open"), F.concat(state["kept"], F.when(stack == "", "1").otherwise("0")).alias("kept"))

    def text(piece: Column, flag: Column) -> Column:
        marked_piece = F.startswith(piece, F.lit(_OPEN)) | F.startswith(piece, F.lit(_CLOSE))
        return F.when(flag == "1", F.when(marked_piece, F.substr(piece, F.lit(3))).otherwise(piece))

    # The fold leaves a flag per piece, and the join passes over nulls, so pieces are not copied from step to step.
    flags = F.split(F.aggregate(pieces, start, step)["kept"], "")
    return F.array_join(F.zip_with(pieces, flags, text), _NODE)


def html_to_text(page: Column) -> Column:
    """Visible text of a page: text nodes stripped and joined by one space."""
    raw = "|".join(RAW_ELEMENTS)
    out = F.translate(page, f"{_NODE}{_OPEN}{_CLOSE}", "   ")
    out = F.regexp_replace(out, rf"(?is)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<({raw})(?:\s[^>]*)?>.*?(?:</\1\s*>|\z)", _NODE)
    for number, name in enumerate(DROPPED_ELEMENTS):
        out = F.regexp_replace(out, rf"(?is)<{name}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", f"{_OPEN}{number}")
        out = F.regexp_replace(out, rf"(?is)</{name}\s*>", f"{_CLOSE}{number}")
    marked = F.when(out.rlike(f"[{_OPEN}{_CLOSE}]"), _outside_dropped(out)).otherwise(out)
    nodes = F.transform(F.split(decode_entities(F.regexp_replace(marked, f"(?s){_TAG}", _NODE)), _NODE), strip)
    return F.array_join(F.filter(nodes, lambda n: n != ""), " ")


def html_title(page: Column) -> Column:
    """Trimmed title of a page, or ``""``."""
    return strip(decode_entities(F.regexp_extract(page, r"(?is)<title(?:\s[^>]*)?>(.*?)</title", 1)))


def html_author(page: Column) -> Column:
    """Content of the author meta element, or ``""``."""
    tag = F.regexp_extract(page, r"""(?is)<meta\s[^>]*\bname\s*=\s*["']?author["']?[^>]*>""", 0)
    quoted = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*(["'])(.*?)\1""", 2)
    return decode_entities(quoted)


def created_at(doc_created: Column) -> Column:
    """The creation date of a document, which is kept as it was written, as a timestamp; null if it is none."""
    return F.try_to_timestamp(doc_created)


# --- JSON ---------------------------------------------------------------------------------------------------------

def scalars(document, max_depth: float = math.inf) -> str:
    """Text of a parsed JSON value: its scalars in order, joined by a space. A null in an array, an empty array or object and
    whatever lies deeper than ``max_depth`` count as an empty scalar; nulls of an object are left out."""
    found: list[str] = []
    waiting = [(document, 0)]  # last in, first out: members go in backwards
    while waiting:
        value, depth = waiting.pop()
        members = [v for v in value.values() if v is not None] if isinstance(value, dict) else value
        if isinstance(members, list) and members and depth <= max_depth:
            waiting += [(v, depth + 1) for v in reversed(members)]
        else:
            blank = value is None or depth > max_depth or isinstance(members, list)
            found.append("" if blank else str(value))
    return " ".join(found)


@F.pandas_udf(T.StringType())
def flatten_json(docs: pd.Series) -> pd.Series:
    """Every scalar of a JSON text in document order, at any depth that the parser reads (thousands of levels); null for text that is
    not JSON or nested deeper."""

    def flatten(doc):
        try:
            return scalars(json.loads(doc))
        except (TypeError, ValueError, RecursionError):
            return None

    return docs.map(flatten)


# --- rows ---------------------------------------------------------------------------------------------------------


def _plain_number(java: Column) -> Column:
    """A double as printed by the JVM (``1.0E7``, ``Infinity``) in plain notation, from 1e16 on as ``1e+16``."""
    power = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", "")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    digits = F.abs(power).cast("string")
    plain = F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    return (
        F.when(java == "NaN", F.lit("nan"))
        .when(java.endswith("Infinity"), F.replace(java, F.lit("Infinity"), F.lit("inf")))
        .when(power.between(-4, 15), F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain))
        .otherwise(F.concat(mantissa, sign, F.when(F.abs(power) < 10, F.lpad(digits, 2, "0")).otherwise(digits)))
    )


def value_text(df: DataFrame, name: str) -> Column:
    """A column's value as text; doubles print in plain notation from 1e-4 up to 1e16.

    The rare forms are rewritten inside a lambda, which is not inlined into the generated code of every column.
    """
    text = F.col(f"`{name}`").cast("string")
    if not isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return text
    return F.when(text.rlike("[EIN]"), F.transform(F.array(text), _plain_number)[0]).otherwise(text)


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """``name: value`` pairs joined by `` | ``; null and blank values are left out."""
    pairs = []
    for name in columns:
        value = value_text(df, name)
        pair = F.concat(F.lit(f"{name}: "), value)
        pairs.append(F.when(~is_blank(value), pair) if isinstance(df.schema[name].dataType, T.StringType) else pair)
    return F.concat_ws(" | ", *pairs) if pairs else F.lit("")


def template_text(df: DataFrame, template: str, columns: list[str]) -> Column:
    """Fill ``{column}`` fields; null gives ``""``. An unknown column fails before any row is read."""
    if len(template) > 4096:
        raise ValueError("row template is limited to 4096 characters")
    parts: list[Column] = []
    for literal, field, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if spec or conversion:
            raise ValueError(f"row template field {field!r} must not have a format spec or conversion")
        if field not in columns:
            raise ValueError(f"row template names unknown column {field!r}; available: {columns}")
        parts.append(F.coalesce(value_text(df, field), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
