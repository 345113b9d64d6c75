"""Search: filter, k nearest per query, score, threshold, merge over collections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.embedding import DEFAULT_MODEL, embed
from textquarry.functions.filters import compile_where
from textquarry.functions.validation import check_min_score, check_top_k
from textquarry.functions.vectors import score, shown_distance
from textquarry.operators import collections as coll
from textquarry.operators.approximate import nearest_probed
from textquarry.operators.hits import answer_context, answer_prompt
from textquarry.operators.inverted_file import InvertedFile, nearest_filed
from textquarry.operators.nearest import MAX_BROADCAST_QUERIES, nearest
from textquarry.schema import HIT_DEFAULTS, hit_field


def embed_queries(queries: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """``qid, query_text`` with their vectors."""
    return queries.select("qid", "query_text", embed(F.col("query_text"), model).alias("embedding"))


def embed_chunks(chunks: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    return chunks.withColumn("embedding", embed(F.col("text"), model))


def _candidates(chunks: DataFrame, where: Mapping | None, carry: Sequence[str]) -> DataFrame:
    """Filtered chunks, reduced to the columns a hit shows. The filter comes before any distance."""
    test = compile_where(where, chunks.schema)
    kept = chunks if test is None else chunks.where(test)
    have = set(kept.columns)
    return kept.select(
        "id",
        "embedding",
        *[hit_field(c, have) if c in HIT_DEFAULTS else F.col(c) for c in carry],
    )


def _scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", score(F.col("distance"))).withColumn("distance", shown_distance(F.col("distance")))


def _carried(chunks: DataFrame, carry: Sequence[str] | None) -> list[str]:
    if carry is not None:
        return list(carry)
    return [*(["text"] if "text" in chunks.columns else []), *HIT_DEFAULTS]


def search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    where: Mapping | None = None,
    min_score: float | None = None,
    collection: str | None = None,
    collections: DataFrame | None = None,
    carry: Sequence[str] | None = None,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
    approximate: bool | InvertedFile = False,
) -> DataFrame:
    """The ``k`` best chunks of every query, nearest first: ``qid, rank, id, distance, score`` and the carried columns.

    With a trained index as ``approximate``, only the cells near a query are searched (see ``operators.inverted_file``), with
    ``True`` the buckets of fixed hyperplanes (see ``operators.approximate``). ``min_score`` cuts the ranked list by the rounded score; it never changes which chunks are ranked.
    """
    check_top_k(k)
    check_min_score(min_score)
    if collection is not None:
        if collections is not None:
            coll.require(collections, collection)
        chunks = chunks.where(F.col("collection") == collection)
    carry = _carried(chunks, carry)
    # An id is unique within its collection only.
    place = ["collection"] if "collection" in chunks.columns and "collection" not in carry else []
    filed = "cell" if isinstance(approximate, InvertedFile) else "bucket"
    bucket = [filed] if approximate and filed in chunks.columns else []
    candidates = _candidates(chunks, where, [*place, *bucket, *carry])
    key = ["id", *[c for c in candidates.columns if c == "collection"]]
    if approximate:
        filed = isinstance(approximate, InvertedFile)
        found = nearest_filed(queries, candidates, approximate, k, key) if filed else nearest_probed(queries, candidates, k, key=key)
        hits = _scored(found.join(candidates.drop("embedding"), key))
    else:
        hits = _scored(nearest(queries, candidates, k, max_broadcast=max_broadcast, key=key))
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    return hits.select("qid", "rank", "id", "distance", "score", *carry)


def search_many(
    queries: DataFrame,
    chunks: DataFrame,
    names: Sequence[str],
    k: int = 5,
    where: Mapping | None = None,
    min_score: float | None = None,
    carry: Sequence[str] | None = None,
    cut: bool = True,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Search several collections in one pass and merge by score.

    Each collection gives its own ``k`` best; the merged list is ordered by rounded score, then by the position of the
    collection in ``names``, then by rank inside it, and cut to ``k`` unless ``cut`` is off. Unknown names give nothing.
    """
    check_top_k(k)
    check_min_score(min_score)
    if not names:
        raise ValueError("search_many needs the name of a collection")
    names = list(names)
    wanted = chunks.where(F.col("collection").isin(names))
    carry = _carried(chunks, carry)
    candidates = _candidates(wanted, where, ["collection", *carry])
    hits = _scored(nearest(queries, candidates, k, "collection", max_broadcast=max_broadcast, n_groups=len(set(names))))
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    # A name given twice counts twice, as two searches would.
    places = F.filter(
        F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("name")) for i, n in enumerate(names)]),
        lambda p: p["name"] == F.col("collection"),
    )
    hits = hits.withColumn("_place", F.explode(places))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("_place.at"), "rank")
    merged = hits.withColumn("rank", F.row_number().over(order))
    if cut:
        merged = merged.where(F.col("rank") <= k)
    return merged.select("qid", "rank", "collection", "id", "distance", "score", *carry)


def contexts(queries: DataFrame, chunks: DataFrame, prefix: str | None = None, **options) -> DataFrame:
    """Search one collection and assemble the prompt of every query that has hits."""
    return answer_prompt(answer_context(search(queries, chunks, **options)), prefix)


def contexts_many(
    queries: DataFrame, chunks: DataFrame, names: Sequence[str], prefix: str | None = None, **options
) -> DataFrame:
    """Search several collections and assemble the prompt of every query that has hits."""
    return answer_prompt(answer_context(search_many(queries, chunks, names, **options)), prefix)
