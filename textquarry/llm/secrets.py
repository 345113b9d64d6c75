"""Secret scans through a trigram inverted index.

From each rule's pattern a Boolean trigram query is derived: the strings that any match must hold at some place, each as the AND of
its trigrams, OR-ed. All texts are indexed for the trigrams that the rules ask for (folded to lower case); postings are intersected
per rule, and only the documents found are searched by that rule's pattern. A rule whose pattern has no mandatory trigram (a run of
hex digits) scans all texts in full.

Built-in functions only. A match's place comes from the text between matches: ``split`` and ``regexp_extract_all`` by one pattern
alternate, so starts are running sums of lengths in code points. Nulls: a null text is empty. Rows with null or repeated ids are
scanned one by one; equal rows share a posting. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import let, stored


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are spans of ``kind`` if their ``group`` is at least ``least`` characters long; others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules, then those that this scan adds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs of 16 and more: shorter runs would be dropped as a whole, and a run is one match.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_password", r"://[^\s/:@]+:[^\s/:@]+@"),
)


def _strings(tree, most: int = 64) -> tuple[list[set[str]], bool]:
    """Sets of strings, one of each of which every match of a parsed pattern holds; and whether the last set is the whole match."""
    done: list[set[str]] = []
    run, whole = {""}, True

    def cut() -> None:
        nonlocal run, whole
        if run != {""}:
            done.append(run)
        run, whole = {""}, False

    for op, value in tree:
        name = str(op)
        options: set[str] | None = None
        if name == "LITERAL":
            options = {chr(value)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
            options = {chr(v) for _, v in value}
        elif name == "SUBPATTERN":
            inner, exact = _strings(value[-1], most)
            options = inner[0] if exact and len(inner) == 1 else None
            if options is None:
                cut()
                done += inner
                continue
        elif name == "BRANCH":
            parts = [_strings(branch, most) for branch in value[1]]
            if all(exact and len(sets) == 1 for sets, exact in parts):
                options = set().union(*(sets[0] for sets, _ in parts))
        elif name == "MAX_REPEAT" and value[:2] == (0, 1):
            inner, exact = _strings(value[2], most)
            options = {"", *inner[0]} if exact and len(inner) == 1 else None
        elif name == "MAX_REPEAT" and value[0] > 0:
            cut()
            done += _strings(value[2], most)[0]
            continue
        joined = {a + b for a, b in product(run, options)} if options is not None else None
        if joined is None or len(joined) > most:
            cut()
        else:
            run = joined
    if run != {""} or whole:
        done.append(run)
    return done, whole


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each the trigrams that all must be there, of the most telling part of a pattern; none if no part has any."""
    # The standard library's own parse tree of a pattern.
    from re import _parser

    best: list[frozenset[str]] = []
    for strings in _strings(_parser.parse(pattern))[0]:
        if min(map(len, strings)) < 3:
            continue
        sets = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        sets = {s for s in sets if not any(o < s for o in sets)}
        if not best or min(map(len, sets)) > min(map(len, best)):
            best = sorted(sets, key=sorted)
    return best


def index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: ``trigram, id_, tag_`` for each row of ``texts`` (``id_, tag_, body``) that holds the trigram."""
    folded = texts.select("id_", "tag_", F.lower(F.coalesce("body", F.lit(""))).alias("low_"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low_"), t))
    return folded.select("id_", "tag_", F.explode(held).alias("trigram")).dropDuplicates()


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``id_, tag_, kinds``: the rules whose Boolean query a row fulfils, by intersecting postings."""
    terms = [(kind, n, t, len(every)) for kind, any_of in queries.items() for n, every in enumerate(any_of) for t in sorted(every)]
    wanted = postings.sparkSession.createDataFrame(terms, "kind string, way int, trigram string, size int")
    met = postings.join(F.broadcast(wanted), "trigram")  # some rows for each rule
    whole = met.groupBy("id_", "tag_", "kind", "way").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).where("n = size")
    return whole.groupBy("id_", "tag_").agg(F.collect_set("kind").alias("kinds"))


def _running(lengths: Column, base: Column) -> Column:
    """``base`` plus the sum of the lengths before each place."""
    empty = F.struct(base.cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
    return F.aggregate(lengths, empty, step)["all"]


def _starts(lengths: Column, block: int = 256) -> Column:
    """Running sums in two levels, so that a text with very many matches does not copy long arrays for each of them."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / block), F.lit(0)).cast("int")),
        lambda b: F.slice(lengths, b * block + 1, F.lit(block)),
    )

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, n: s + n))
        return let(_running(sums, F.lit(0)), lambda base: F.flatten(F.transform(parts, lambda p, i: _running(p, F.get(base, i)))))

    return let(blocks, joined)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """``(start, rank, kind, end)`` of a rule's matches in a text, leftmost first, without those that are too short."""
    pattern = F.lit(rule.pattern)
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"

    def placed(found: Column) -> Column:
        between = F.split(text, rule.pattern, -1)
        # Lengths of text, match, text, match, ...: the running sum before every match is its start.
        lengths = F.flatten(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.array(F.length(b), F.length(m))))
        tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
        made = let(
            _starts(lengths),
            lambda at: F.transform(
                F.arrays_zip(found.alias("m"), tested.alias("v")),
                lambda f, i: F.struct(
                    F.get(at, 2 * i + 1).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                    (F.get(at, 2 * i + 1) + F.length(f["m"])).alias("end"), F.length(f["v"]).alias("long"),
                ),
            ),
        )
        long = F.filter(made, lambda s: s["long"] >= rule.least)
        return F.transform(long, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast(kind)
    return let(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none)).cast(kind)


def _listed(all_spans: Column) -> Column:
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``doc_id, found``: all spans of each document as ``(start, rank, kind, end)``, by start and then in the order of the rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q}
    key = F.col(doc_id).cast("long")
    rows = docs.select(
        key.alias("doc_id"), F.coalesce(key, F.lit(0)).alias("id_"), F.xxhash64(key, F.col(text)).alias("tag_"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    trigrams = sorted(set().union(*(t for q in indexed.values() for t in q))) if indexed else []
    postings = stored(index(rows, trigrams), "postings")
    found = candidates(postings, indexed)
    joined = rows.join(found, ["id_", "tag_"], "left")
    body, kinds = F.col("body"), F.coalesce("kinds", F.array().cast("array<string>"))
    each = []
    for rank, rule in enumerate(rules):
        verified = spans(body, rule, rank)
        if rule.kind in indexed:
            verified = F.when(F.array_contains(kinds, rule.kind), verified).otherwise(F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
        each.append(verified)
    return joined.select("doc_id", F.sort_array(F.concat(*each)).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans of the base rules, and the spans of all rules, as text."""
    found = find_secrets(docs)
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
    )


