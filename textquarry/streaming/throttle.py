"""Change events of watched folders, thinned to at most one emission per interval and folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

def _timed(changes: DataFrame) -> DataFrame:
    """Event time as a timestamp with time zone, which watermarks ask for."""
    return changes.withColumn("ts", F.col("ts").cast("timestamp"))


def path_windows(changes: DataFrame, interval: str = "3 seconds", delay: str = "10 seconds") -> DataFrame:
    """``folder, emitted_at, path, changes`` per tumbling window of event time. Counts combine before the shuffle, and a busy folder
    is spread over its paths."""
    if changes.isStreaming:
        changes = _timed(changes).withWatermark("ts", delay)
    windowed = changes.groupBy(F.window("ts", interval).alias("w"), "folder", "path").agg(F.count(F.lit(1)).alias("changes"))
    return windowed.select("folder", F.col("w.end").alias("emitted_at"), "path", "changes")


def fold_paths(windows: DataFrame) -> DataFrame:
    """``folder, emitted_at, changes, paths``: the rows of ``path_windows`` by window, with the exact number of paths (a null is none).
    A path is one row by now, so both numbers are plain sums that combine before the shuffle."""
    return windows.groupBy("folder", "emitted_at").agg(F.sum("changes").alias("changes"), F.count("path").alias("paths"))


def throttle_windows(changes: DataFrame, interval: str = "3 seconds", delay: str = "10 seconds") -> DataFrame:
    """``folder, emitted_at, changes, paths`` per window. Of a stream, the windows by path: ``write_windows`` keeps those, and
    ``latest_windows`` folds them."""
    windows = path_windows(changes, interval, delay)
    return windows if changes.isStreaming else fold_paths(windows)


def stamp_windows(changes: DataFrame, interval: str = "3 seconds") -> DataFrame:
    """Every change with the end of its window, duplicates kept. No grouping, so no state and no shuffle."""
    return changes.select("folder", F.window("ts", interval)["end"].alias("emitted_at"), "ts", "path")


def change_events(changes: DataFrame, interval: str = "3 seconds", delay: str = "10 seconds", parts: int = 16) -> DataFrame:
    """``folder, emitted_at, part, paths``: the paths of each window as lists. The list of a folder comes in up to
    ``parts`` pieces, so that one which sees very many changes at once does not gather in one task."""
    if changes.isStreaming:
        changes = _timed(changes).withWatermark("ts", delay)
    part = F.pmod(F.xxhash64("path", "ts"), F.lit(parts)).cast("int")
    grouped = changes.groupBy(F.window("ts", interval).alias("w"), "folder", part.alias("part"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ts", "path"))), lambda c: c["path"])
    return grouped.agg(listed.alias("paths")).select("folder", F.col("w.end").alias("emitted_at"), "part", "paths")


def write_windows(windows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the windows of a stream below ``path``, also those that its watermark has not closed yet: each micro-batch
    appends the windows it changed. ``latest_windows`` reads the last state of each. A batch that is run again appends
    equal rows."""

    def append(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)

    writer = windows.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "3 seconds"})).start()


def latest_windows(written: DataFrame) -> DataFrame:
    """The last state of every window that ``write_windows`` kept: of each path its last count, summed by window."""
    last = F.max_by("changes", "epoch").alias("changes")
    return fold_paths(written.groupBy("folder", "emitted_at", "path").agg(last))


def every(spark, work: Callable[[], None], checkpoint: str, interval: str) -> StreamingQuery:
    """Run ``work`` once per interval by a stream that only ticks, until it is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _batch, _epoch: work()).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start()
