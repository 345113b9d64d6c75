"""Mixing to target weights with soft memberships: domain posteriors of every document, and rates fitted by projected gradients.

A classifier learns the domains from a labelled table: naive Bayes over the presence of a few telling tokens per domain, counted
with DataFrame aggregations on at most ``max_labelled`` labelled documents (by hash order, a documented bound; every other figure
covers all documents). It gives every document a posterior over the domains, from its whole text.

Rates r >= 0 are then fitted to the expected domain totals T_k(r) = sum over documents of r_d * tokens_d * p_dk, so that they meet
targets tau_k. The least squares are weighted by the inverse of the domains' Gram matrix G = sum of tokens_d p_d p_d', and a
rate's step is measured per token, so the gradient of a document is p_d' G^-1 (T(r) - tau), the Lipschitz constant of the problem is one,
and a projected gradient step is r <- max(0, r - p_d' G^-1 (T(r) - tau)). Every step is one aggregation over the thin table of
posteriors; between steps the driver keeps one small vector per step, from which each task works out the rate of a document. After
``steps_per_table`` steps the rates are written down, so that the work per step stays bounded.

Built-in functions only. Nulls: a null text has no tokens; its posterior is the prior's and its rate counts for nothing. Labels that
are null, or name no document, are not learnt from. Documents with null or repeated ids are rated one by one. Without any label the
posterior is uniform. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import let, stored

# A token is a run of letters and digits, or a run of other characters that are no white space.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"


@dataclass(frozen=True)
class MixingOptions:
    tokens_per_domain: int = 40
    max_labelled: int = 50_000
    smoothing: float = 1.0
    max_steps: int = 40
    steps_per_table: int = 8
    tolerance: float = 1e-4


def label_domain(quality: Column, toxic: Column) -> Column:
    """The domain that a pair of labels names: toxic, else low or high quality."""
    return F.when(toxic == 1, "toxic").when((toxic == 0) & (quality == 0), "low").when((toxic == 0) & (quality == 1), "high")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _sketch(found: Column) -> Column:
    """The least hash of the three-token windows of a text: mostly the same for near copies, which must not teach a token twice."""
    last = F.greatest(F.size(found) - 3, F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)))
    return F.array_min(windows)


@dataclass(frozen=True)
class Classifier:
    """``bias`` and per-token ``delta`` of the log score of each domain."""

    domains: list[str]
    tokens: list[str]
    bias: np.ndarray
    delta: np.ndarray

    def odds(self, present: Column) -> Column:
        """Odds in the order of ``domains``, the greatest 1, from the telling tokens that a text holds."""
        scores = []
        for k in range(len(self.domains)):
            score = F.lit(float(self.bias[k]))
            if self.tokens:
                weights = F.array(*[F.lit(float(x)) for x in self.delta[:, k]])
                score = score + F.aggregate(present, F.lit(0.0), lambda s, i: s + F.get(weights, i))
            scores.append(score)
        return let(F.array(*scores), lambda all_: F.transform(all_, lambda s: F.exp(s - F.array_max(all_))))

    def present(self, found: Column) -> Column:
        """Places in ``tokens`` of those that a text holds, in order."""
        if not self.tokens:
            return F.array().cast("array<int>")
        known = F.array(*[F.lit(t) for t in self.tokens])
        hit = F.array_intersect(found, known)
        return F.transform(F.array_sort(F.transform(hit, lambda t: F.array_position(known, t))), lambda i: (i - 1).cast("int"))


def train(docs: DataFrame, labels: DataFrame, domains: list[str], options: MixingOptions = MixingOptions()) -> Classifier:
    """``docs``: ``doc_id, text``; ``labels``: ``doc_id, domain``. The driver gets class counts and the chosen tokens only."""
    named = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "domain"])
    chosen = named.orderBy(F.xxhash64("doc_id", "domain"), "doc_id").limit(options.max_labelled)
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    # At most ``max_labelled`` rows of an id and a domain: bounded, so texts are picked where they are read.
    read = texts.join(F.broadcast(chosen), "doc_id").select("domain", tokens(F.col("text")).alias("all"))
    sample = read.select("domain", F.array_distinct("all").alias("found"), _sketch(F.col("all")).alias("sketch"))
    sample = stored(sample.dropDuplicates(["domain", "sketch"]).drop("sketch"), "labelled")
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([sizes.get(d, 0) for d in domains], float)
    total = n.sum()
    bias = np.log((n + options.smoothing) / (total + options.smoothing * len(domains)))
    if not total:
        return Classifier(domains, [], np.zeros(len(domains)), np.zeros((0, len(domains))))
    counts = sample.select("domain", F.explode("found").alias("token")).groupBy("token").agg(
        *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)]
    )
    counts = stored(counts, "token-counts")
    seen = sum(F.col(f"n{k}") for k in range(len(domains)))
    best: dict[str, list[int]] = {}
    for k in range(len(domains)):
        # Chi-square of one domain against the rest; tokens are taken by it, ties by the token itself.
        inside, of = F.col(f"n{k}").cast("double"), F.lit(float(n[k]))
        rest, others = (seen - F.col(f"n{k}")).cast("double"), F.lit(float(total - n[k]))
        cross = inside * (others - rest) - rest * (of - inside)
        spread = seen * (total - seen) * float(n[k]) * float(total - n[k])
        chi = F.when(spread > 0, cross * cross * float(total) / spread).otherwise(0.0)
        top = counts.withColumn("chi", chi).where("chi > 0").orderBy(F.desc("chi"), "token").limit(options.tokens_per_domain)
        for r in top.collect():
            best[r["token"]] = [r[f"n{j}"] for j in range(len(domains))]
    known = sorted(best)
    held = np.array([best[t] for t in known], float).reshape(-1, len(domains))
    p = (held + options.smoothing) / (n + 2 * options.smoothing)
    return Classifier(domains, known, bias + np.log1p(-p).sum(axis=0), np.log(p) - np.log1p(-p))


def classified(docs: DataFrame, model: Classifier, carry: tuple[str, ...]) -> DataFrame:
    """``carry``, ``n_tokens`` and the posterior ``p`` (an array in the order of the domains) of every document."""
    found = docs.select(*carry, tokens(F.col("text")).alias("found_"))
    held = found.select(*carry, F.size("found_").cast("long").alias("n_tokens"), model.present(F.col("found_")).alias("present_"))
    scored = held.select(*carry, "n_tokens", model.odds(F.col("present_")).alias("odds_"))
    total = F.aggregate("odds_", F.lit(0.0), lambda s, x: s + x)
    return scored.select(*carry, "n_tokens", F.transform("odds_", lambda x: x / total).alias("p"))


def _rate(start: Column, p: Column, steps: list[np.ndarray]) -> Column:
    """The rate after some steps: a fold over their small vectors."""
    if not steps:
        return start
    pulls = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    dot = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(pulls, start, lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


@dataclass(frozen=True)
class Fit:
    rated: DataFrame
    expected: np.ndarray
    target: np.ndarray
    reached: np.ndarray
    steps: int


def fit_rates(posteriors: DataFrame, weights: list[float], budget: float | None = None, headroom: float = 1.0, options: MixingOptions = MixingOptions()) -> Fit:
    """``posteriors`` with a ``rate``. ``weights``: the wanted share of each domain. ``budget``: wanted tokens in all; if none is
    given, what leaves the domain of the greatest weight as it is (times ``headroom``)."""
    k = len(weights)
    n = F.col("n_tokens").cast("double")
    sums = [F.sum(n * F.col("p")[i]) for i in range(k)]
    gram = [F.sum(n * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(k)]
    got = [x or 0.0 for x in posteriors.agg(*sums, *gram).first()]
    expected, g = np.array(got[:k]), np.array(got[k:]).reshape(k, k)
    share = np.array(weights) / sum(weights)
    if budget is None:
        main = int(np.argmax(share))
        budget = headroom * float(expected[main] / share[main])
    target = share * budget
    inverse = np.linalg.pinv(g, hermitian=True, rcond=1e-12)
    start = float(budget / expected.sum()) if expected.sum() > 0 else 0.0
    table, rate, steps, taken = posteriors, F.lit(start), [], 0
    reached = expected * start
    while taken < options.max_steps and expected.sum() > 0:
        if np.abs(reached - target).sum() <= options.tolerance * budget:
            break
        steps.append(inverse @ (reached - target))
        taken += 1
        if len(steps) == options.steps_per_table:
            table = stored(table.withColumn("rate", _rate(rate, F.col("p"), steps)), "rates")
            rate, steps = F.col("rate"), []
        now = table.select("n_tokens", "p", _rate(rate, F.col("p"), steps).alias("r_"))
        before, reached = reached, np.array([x or 0.0 for x in now.agg(*[F.sum(F.col("r_") * n * F.col("p")[i]) for i in range(k)]).first()])
        if np.abs(reached - before).sum() <= options.tolerance * budget / 10:
            break  # the targets are out of reach of nonnegative rates, and this is the nearest
    return Fit(table.withColumn("rate", _rate(rate, F.col("p"), steps)), expected, target, reached, taken)


DOMAINS = ["high", "low", "toxic"]
# The mixture the query and the pipeline ask for: mostly high quality, nothing toxic.
WEIGHTS = [0.9, 0.1, 0.0]


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    weights: list[float] | None = None,
    headroom: float = 1.0,
    options: MixingOptions = MixingOptions(),
) -> Fit:
    """Rates of all documents. ``labels``: ``doc_id, quality, toxic``. The posteriors are written once, without texts unless they
    are carried. ``headroom`` multiplies the budget that leaves the main domain as it is."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(texts, named, DOMAINS, options)
    held = docs.select(F.struct(*carry).alias("carried"), "text")
    rows = stored(classified(held, model, ("carried",)), "posteriors")
    return fit_rates(rows, weights or WEIGHTS, headroom=headroom, options=options)


def copies(rate: Column, *key: Column) -> Column:
    """How often a document enters the mixture: the rate, rounded up with the probability of its fraction, by a hash of the key."""
    chance = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + chance).cast("int")


def mix(docs: DataFrame, labels: DataFrame, headroom: float = 1.1) -> DataFrame:
    """The rows of ``docs`` that enter the mixture, once each, with their own columns.

    The head room puts the rate of the main domain above one, so its documents all stay; a rate above one does not repeat
    a document here. Documents of other domains stay with the probability of their rate.
    """
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    fit = mixing_rates(whole, labels, carry=("row",), headroom=headroom)
    row = F.col("carried.row")
    return fit.rated.where(copies(F.col("rate"), row["doc_id"], row["text"]) >= 1).select("carried.row.*")
