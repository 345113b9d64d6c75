"""Collections under one folder: ingest, search and maintain them by name.

Everything here is a few calls to the operators; use those directly for chunk tables of your own. A collection has an
id that its chunks are stored under and a name that can change, so renaming moves no data, and dropping one only marks
it; ``compact`` writes a library without it.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textquarry.errors import CollectionExistsError, CollectionNotFoundError
from textquarry.functions.embedding import DEFAULT_MODEL
from textquarry.functions.validation import check_collection_name, check_description, check_model_name, check_request
from textquarry.operators import collections as coll
from textquarry.operators.changes import purge_counts, stale_sources
from textquarry.operators.hits import answer_context, answer_prompt
from textquarry.operators.ingest import Ingest, IngestOptions, ingest_files, ingest_table
from textquarry.operators.inverted_file import InvertedFile, train
from textquarry.operators.outcomes import ingest_report
from textquarry.operators.search import embed_queries, search, search_many
from textquarry.schema import conform
from textquarry.session import apply_defaults, materialize
from textquarry.sinks.store import ChunkStore
from textquarry.sources.files import list_files, scan_files, scan_paths, stored_path
from textquarry.sources.tables import open_table
from textquarry.streaming.watch import follow_folder, reconcile, watch_folder

CATALOG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("removed", T.BooleanType()),
        T.StructField("version", T.LongType()),
    ]
)


class TextLibrary:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = apply_defaults(spark), root
        self.store = ChunkStore(spark, root)

    # --- the catalog: one row per change of a collection, the last one counts ---

    def _catalog(self) -> DataFrame:
        try:
            log = self.spark.read.schema(CATALOG).parquet(os.path.join(self.root, "collections"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            log = self.spark.createDataFrame([], CATALOG)
        last = log.groupBy("id").agg(F.max_by(F.struct("name", "embedding_model", "description", "removed"), "version").alias("l"))
        return last.select("id", "l.*").where("not removed").drop("removed")

    def _record(self, row: Mapping, **changes) -> None:
        values = {"description": "", "removed": False, **row, **changes, "version": time.time_ns()}
        change = self.spark.createDataFrame([tuple(values[f] for f in CATALOG.names)], CATALOG)
        change.coalesce(1).write.mode("append").parquet(os.path.join(self.root, "collections"))

    def _find(self, name: str) -> dict | None:
        row = self._catalog().where(F.col("name") == name).first()
        return row.asDict() if row else None

    def _get(self, name: str) -> dict:
        found = self._find(name)
        if found is None:
            raise CollectionNotFoundError(f"collection not found: {name!r}")
        return found

    def create(self, name: str, model: str = DEFAULT_MODEL) -> dict:
        """Get the collection or make it. The model it was made with stays."""
        found = self._find(name)
        if found:
            coll.create_collection(self.collections(), name, model)
            return found
        check_collection_name(name)
        check_model_name(model)
        self._record({"id": uuid.uuid4().hex, "name": name, "embedding_model": model})
        return self._get(name)

    def collections(self) -> DataFrame:
        return self._catalog().select("name", "embedding_model", "description")

    def list_collections(self) -> DataFrame:
        return coll.list_collections(self.collections())

    def chunks(self, *names: str) -> DataFrame:
        """Current chunks of the named collections, or of all, under their names. Unknown names give nothing."""
        catalog = self._catalog().select(F.col("id").alias("collection"), "name")
        if names:
            catalog = catalog.where(F.col("name").isin(list(names)))
            # Few names: their ids prune the partitions of the store. "" stands for none of them.
            stored = self.store.current(*[r["collection"] for r in catalog.collect()] or [""])
        else:
            stored = self.store.current()
        named = stored.join(materialize(catalog), "collection").withColumn("collection", F.col("name"))
        return conform(named)

    # --- ingest ---

    def _finish(self, run: Ingest) -> DataFrame:
        self.store.append(run)
        return ingest_report(run.outcomes)

    def _options(self, found: dict, options: IngestOptions) -> IngestOptions:
        return replace(options, embedding_model=found["embedding_model"] or DEFAULT_MODEL, materialize=True)

    def ingest(self, folder: str, name: str, options: IngestOptions = IngestOptions(), model: str = DEFAULT_MODEL) -> DataFrame:
        """Ingest a folder; returns the one-row report."""
        files = scan_files(self.spark, folder)
        found = self.create(name, model)
        known = self.store.known_files(found["id"])
        return self._finish(ingest_files(files, found["id"], known, self._options(found, options)))

    def ingest_many(self, paths: DataFrame, folder: str, name: str, options: IngestOptions = IngestOptions(), model: str = DEFAULT_MODEL) -> DataFrame:
        """Ingest a list of paths below a folder; missing and unsupported ones are reported as skipped."""
        found = self.create(name, model)
        files = scan_paths(paths, list_files(self.spark, folder))
        known = self.store.known_files(found["id"])
        return self._finish(ingest_files(files, found["id"], known, self._options(found, options)))

    def ingest_table(
        self,
        table: DataFrame | str,
        source: str,
        name: str,
        columns: list[str] | None = None,
        id_column: str = "id",
        template: str | None = None,
        options: IngestOptions = IngestOptions(),
        model: str = DEFAULT_MODEL,
    ) -> DataFrame:
        """Ingest the rows of a table, given as a DataFrame or by its name in the catalog of Spark."""
        rows = open_table(self.spark, table) if isinstance(table, str) else table
        found = self.create(name, model)
        known = self.store.known_rows(found["id"], source)
        run = ingest_table(rows, source, found["id"], known, columns, id_column, template, self._options(found, options))
        return self._finish(run)

    def watch(self, folder: str, name: str, checkpoint: str, options: IngestOptions = IngestOptions(), **how) -> StreamingQuery:
        found = self.create(name)
        return watch_folder(self.spark, folder, self.store, found["id"], checkpoint, options=self._options(found, options), **how)

    def follow(self, folder: str, name: str, checkpoint: str, interval: str = "1 minute", options: IngestOptions = IngestOptions()) -> StreamingQuery:
        """Keep a collection in line with a folder: new, edited and deleted files, once per interval."""
        found = self.create(name)
        return follow_folder(self.spark, folder, self.store, found["id"], checkpoint, interval, self._options(found, options))

    def reconcile(self, folder: str, name: str, options: IngestOptions = IngestOptions()) -> DataFrame:
        found = self._get(name)
        return ingest_report(reconcile(self.spark, folder, self.store, found["id"], self._options(found, options)))

    # --- search ---

    def _queries(self, queries: DataFrame | Sequence[str] | str, model: str) -> DataFrame:
        if not isinstance(queries, DataFrame):
            texts = [queries] if isinstance(queries, str) else list(queries)
            queries = self.spark.createDataFrame(list(enumerate(texts)), "qid long, query_text string")
        return embed_queries(queries, model)

    def query(
        self,
        queries: DataFrame | Sequence[str] | str,
        name: str | Sequence[str],
        k: int = 5,
        where: Mapping | None = None,
        min_score: float | None = None,
        approximate: bool | InvertedFile = False,
    ) -> DataFrame:
        """Ranked hits for one text, a list of texts, or a table of ``qid, query_text``.

        One name searches that collection, which must exist; a list merges the ones that exist. Queries are embedded
        by the model of the collection; merged collections must share theirs. One collection can be searched
        approximately, best by an index that ``train_index`` made.
        """
        if isinstance(name, str):
            model = self._get(name)["embedding_model"] or DEFAULT_MODEL
            return search(self._queries(queries, model), self.chunks(name), k=k, where=where, min_score=min_score, approximate=approximate)
        models = coll.embedding_models(self.collections().where(F.col("name").isin(list(name)))).collect()
        if len(models) > 1:
            raise ValueError(f"collections of different models: {[m[0] for m in models]}")
        model = models[0][0] if models else DEFAULT_MODEL
        return search_many(self._queries(queries, model), self.chunks(*name), name, k=k, where=where, min_score=min_score)

    def train_index(self, name: str, k: int = 5, recall: float = 0.9) -> InvertedFile:
        """An index for ``query(approximate=…)`` over the collection as it is now; keep it with its ``save``."""
        self._get(name)
        return train(self.chunks(name), k, recall)

    def request(self, text: str, name: str | Sequence[str], k: int = 5, where: Mapping | None = None, min_score: float | None = None) -> DataFrame:
        """``query`` for one text from outside, within the limits on the text, the number of results and the filter."""
        check_request(text, k, where)
        return self.query(text, name, k, where, min_score)

    def prompts(self, queries, name, prefix: str | None = None, **options) -> DataFrame:
        """``qid, context, prompt`` of every query with hits, for an answer generator of your own."""
        return answer_prompt(answer_context(self.query(queries, name, **options)), prefix)

    # --- maintenance ---

    def sources(self, name: str) -> DataFrame:
        self._get(name)
        return coll.sources(self.chunks(name))

    def source_counts(self, name: str) -> DataFrame:
        self._get(name)
        return coll.source_counts(self.chunks(name))

    def stats(self, name: str | None = None) -> DataFrame:
        """Statistics of one collection, or of all."""
        if name is None:
            return coll.collection_stats(self.chunks(), self.collections())
        return coll.stats_of(self.chunks(name), self.collections(), name)

    def delete_sources(self, name: str, gone: DataFrame | Sequence[str]) -> DataFrame:
        """Drop sources; returns the chunks dropped per source, 0 where nothing was stored for it.

        A table names sources as they are stored. In a list, a path may also be relative or with ``file:``.
        """
        found = self._get(name)
        if isinstance(gone, DataFrame):
            asked = gone.select("source", F.col("source").alias("asked")).distinct()
        else:
            names = [(kept, s) for s in dict.fromkeys(gone) for kept in dict.fromkeys([s, stored_path(s)])]
            asked = self.spark.createDataFrame(names, "source string, asked string")
        each = coll.deletion_counts(self.chunks(name), name, asked).join(asked, "source")
        counts = materialize(each.groupBy(F.col("asked").alias("source")).agg(F.sum("chunks_deleted").alias("chunks_deleted")))
        self.store.remove(found["id"], asked)
        return counts

    def purge(self, name: str, live: DataFrame) -> DataFrame:
        """Drop chunks whose source is not in ``live``; returns the counts."""
        found = self._get(name)
        chunks = self.chunks(name)
        counts = materialize(purge_counts(chunks, live))
        self.store.remove(found["id"], stale_sources(chunks, live))
        return counts

    def describe(self, name: str, text: str) -> None:
        self._record(self._get(name), description=check_description(text))

    def rename(self, old: str, new: str) -> None:
        check_collection_name(new)
        found = self._get(old)
        if self._find(new):
            raise CollectionExistsError(f"collection already exists: {new!r}")
        self._record(found, name=new)

    def reset(self, name: str, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("reset deletes a whole collection; pass confirm=True")
        found = self._find(name)
        if found:
            self._record(found, removed=True)

    def compact(self, target: str) -> "TextLibrary":
        """A library below another folder with the current state alone: old runs and dropped collections stay behind."""
        fresh = TextLibrary(self.spark, target)
        catalog = self._catalog()
        ids = [r["id"] for r in catalog.select("id").collect()]
        self.store.compact(target, *(ids or [""]))
        log = catalog.withColumns({"removed": F.lit(False), "version": F.lit(time.time_ns())})
        log.select(*CATALOG.names).coalesce(1).write.mode("append").parquet(os.path.join(target, "collections"))
        return fresh
