"""URL filter: rules by host and path, and verdicts for all other hosts by propagating trust and distrust over the link graph.

Rules name a host and a path; a rule fits its host and all subdomains where the url's path begins with the rule's, and the longest
fitting rule decides. A url without a rule gets its host's verdict. Hosts are nodes, the links between pages of different hosts are
edges, weighted by their number. A host's trust seed is the share of its pages that an allow rule admits, its distrust seed the share
that a block rule rejects. Trust is a personalised PageRank from its seeds along the links; distrust is one from its seeds against
the links, so it reaches those who link to blocked hosts:

    score(h) = seed(h) + damping * sum over g -> h of score(g) * (share of g's links that go to h)

Scores grow from round to round, so their total shows how far they still move: rounds go on until it grows by no more than
``tolerance`` of itself, which takes at most log(tolerance) / log(damping) of them, whatever the graph. Each round is written to the
shared folder.

A score is divided among all neighbours, so it shrinks as a graph grows. Verdicts go by relative scores: a score over the most that
the host could have received, were all its neighbours' scores one (and its seed one, where it has one). A host is blocked if its
relative distrust is at least ``threshold`` and above its relative trust: one that links to blocked hosts alone is, however many
others do so too.

Links are the ``href`` of <a> and <area> tags to an address with a host, outside of comments, scripts and styles; a tag is read up to
the next ``<`` or ``>``, and references within a host are not decoded.

Built-in functions throughout; urls and html are read once each and never move, only host pairs and counts do. Nulls: a null url, or
one without ``://``, has an empty host and path, fits no rule and is allowed; null html has no links. Repeated rows are judged and
counted one by one. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import stored

# The rules of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
_LINK = r"""(?i)<(?:a|area)\s(?:[^<>]*?[\s"'/])?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class TrustOptions:
    damping: float = 0.85
    threshold: float = 0.5
    tolerance: float = 1e-6

    def __post_init__(self):
        if not (0 <= self.damping < 1 and 0 < self.tolerance < 1):
            raise ValueError("damping has to be in [0, 1), tolerance in (0, 1)")


def _lower(host: Column) -> Column:
    return F.translate(host, _UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as written; null if none does. Of equally long ones the first."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    verdict = F.lit(None).cast("string")
    for name, says in rules:
        verdict = F.when(rule == name, F.lit(says)).otherwise(verdict)
    return verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts, from the whole html of every page. ``pages``: ``host, html``."""
    links = F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), _NO_MARKUP, " "), F.lit(_LINK), F.lit(1))
    each = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    each = each.select("src", _lower(F.col("dst")).alias("dst")).where("src <> dst")
    return each.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, options: TrustOptions = TrustOptions()) -> DataFrame:
    """``host, kind, score, most``, the last being what the score could be at most. ``seeds``: ``host, kind, seed``, kind 0 for trust and 1 for distrust. ``edges``: ``src, dst, n``."""
    forth = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), "n", F.lit(0).alias("kind"))
    back = edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), "n", F.lit(1).alias("kind"))
    steps = stored(forth.unionByName(back), "steps")
    out = steps.groupBy("host", "kind").agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all") * options.damping
    steps = stored(steps.join(out, ["host", "kind"]).select("host", "kind", "to", share.alias("share")), "steps")
    seeds = stored(seeds.where("seed > 0"), "seeds")
    start = seeds.select("host", "kind", F.col("seed").alias("score"))
    scores, total = start, start.agg(F.sum("score")).first()[0] or 0.0
    while True:
        moved = steps.join(scores, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("share")).alias("score"))
        scores = stored(start.unionByName(moved).groupBy("host", "kind").agg(F.sum("score").alias("score")), "scores")
        now = scores.agg(F.sum("score")).first()[0] or 0.0
        if now - total <= options.tolerance * max(total, 1e-300):
            break
        total = now
    most = start.select("host", "kind", F.lit(1.0).alias("most")).unionByName(steps.select(F.col("to").alias("host"), "kind", F.col("share").alias("most")))
    each = scores.withColumn("most", F.lit(0.0)).unionByName(most.withColumn("score", F.lit(0.0)))
    return each.groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("most").alias("most"))


def judge_urls(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, options: TrustOptions = TrustOptions(), page_id: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    named = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(source).alias("html"))
    ruled = named.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    said = ruled.drop("html").withColumn("said", rule_verdict(F.col("rule"), rules))
    counts = said.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("said") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("said") == "block", 1)).alias("blocked")
    )
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("allowed").alias("k")), F.struct(F.lit(1).alias("kind"), F.col("blocked").alias("k")))
    seeds = counts.select("host", "n", F.explode(kinds).alias("s")).select("host", "s.kind", (F.col("s.k") / F.col("n")).alias("seed"))
    scores = propagate(seeds, host_edges(named.select("host", "html")), options)
    share = lambda kind: F.max(F.when(F.col("kind") == kind, F.try_divide("score", "most")).otherwise(0.0))
    both = scores.groupBy("host").agg(share(0).alias("trust"), share(1).alias("distrust"))
    blocked = (F.col("distrust") >= options.threshold) & (F.col("distrust") > F.col("trust"))
    verdicts = stored(both.where(blocked).select("host", F.lit("block").alias("host_says")), "blocked-hosts")
    joined = said.join(verdicts, "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("said", "host_says", F.lit("allow")).alias("verdict"))
