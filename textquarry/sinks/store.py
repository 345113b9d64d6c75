"""Collections on plain Parquet: two append-only tables and a view of the current state.

``chunks`` gets the new chunks of every run, ``ledger`` one row per source (or table row) that the run replaced or
removed. A run therefore writes only what changed, and change detection reads the ledger and never the chunks. A chunk
is current unless a later run replaced or removed its source. The ledger is written last, and run numbers are times, so
what a failed run left never shows. ``compact`` writes the current state as one run of a new store. One writer at a time.
"""

from __future__ import annotations

import os
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators.changes import without
from textquarry.operators.ingest import Ingest
from textquarry.schema import CHUNK, conform
from textquarry.session import materialize

LEDGER = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("removed", T.BooleanType()),
        T.StructField("run", T.LongType()),
    ]
)
KEY = ["collection", "source", "row_id"]


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(os.path.join(self.root, table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").partitionBy("collection", "run").parquet(os.path.join(self.root, table))

    def _ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def _next_run(self) -> int:
        """A number above every finished run's, and not used by a failed one."""
        last = self._ledger().agg(F.max("run")).first()[0]
        return max(time.time_ns() // 1_000_000, 0 if last is None else last + 1)

    def latest(self) -> DataFrame:
        """The last ledger row of every key: one partial aggregate per task, then one row per key."""
        return self._ledger().groupBy(*KEY).agg(F.max_by(F.struct("run", "hash", "removed"), "run").alias("l")).select(*KEY, "l.*")

    def known_files(self, collection: str) -> DataFrame:
        """``source, stored_hash`` for an incremental run over files."""
        own = self.latest().where((F.col("collection") == collection) & (F.col("row_id") == "") & ~F.col("removed"))
        return own.select("source", F.col("hash").alias("stored_hash"))

    def known_rows(self, collection: str, source: str) -> DataFrame:
        """``row_id, stored_hash`` for an incremental run over a table."""
        own = self.latest().where(
            (F.col("collection") == collection) & (F.col("source") == source) & ~F.col("removed")
        )
        return own.select("row_id", F.col("hash").alias("stored_hash"))

    def append(self, run: Ingest) -> int:
        """Write the new chunks of a run, then its ledger rows."""
        number = self._next_run()
        stamped = F.lit(number).alias("run")
        self._append(run.chunks.select("*", stamped), "chunks")
        row_id = F.col("row_id") if "row_id" in run.replaced.columns else F.lit("")
        self._append(
            run.replaced.select("collection", "source", row_id.alias("row_id"), "hash", F.lit(False).alias("removed"), stamped),
            "ledger",
        )
        return number

    def remove(self, collection: str, gone: DataFrame) -> int:
        """Mark the sources in ``gone`` as removed, every row of a table source included."""
        number = self._next_run()
        own = self.latest().where((F.col("collection") == collection) & ~F.col("removed"))
        dropped = own.join(gone.select("source").distinct(), "source", "left_semi")
        self._append(dropped.select(*KEY, "hash", F.lit(True).alias("removed"), F.lit(number).alias("run")), "ledger")
        return number

    def current(self, *collections: str) -> DataFrame:
        """The chunks of the current state, of all or of the given collections, which prunes both tables.

        What is looked up are the finished runs and the superseded keys, both few next to the chunks.
        """
        schema = T.StructType([*CHUNK.fields, T.StructField("run", T.LongType())])
        chunks, ledger, latest = self._read("chunks", schema), self._ledger(), self.latest()
        if collections:
            own = F.col("collection").isin(*collections)
            chunks, ledger, latest = chunks.where(own), ledger.where(own), latest.where(own)
        last = latest.select(*KEY, F.col("run").alias("_last"), F.col("removed").alias("_removed"))
        old = ledger.where(~F.col("removed")).join(last, KEY).where((F.col("run") < F.col("_last")) | F.col("_removed"))
        superseded = old.select("collection", "source", F.col("row_id").alias("_row"), "run")
        finished = materialize(ledger.select("collection", "run").distinct())
        keyed = chunks.withColumn("_row", F.coalesce("row_id", F.lit("")))
        shown = keyed.join(finished, ["collection", "run"], "left_semi")
        return conform(without(shown, superseded, ["collection", "source", "_row", "run"]))

    def compact(self, target: str, *collections: str) -> "ChunkStore":
        """Write the current state, of all or of the given collections, as the first run of a new store."""
        fresh = ChunkStore(self.spark, target)
        fresh._append(self.current(*collections).withColumn("run", F.lit(0)), "chunks")
        live = self.latest().where(~F.col("removed"))
        live = live.where(F.col("collection").isin(*collections)) if collections else live
        fresh._append(live.withColumn("run", F.lit(0)), "ledger")
        return fresh


