"""Streaming operators over an event table, and a bounded run of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of ``value`` per window and key; rows later than the watermark are dropped."""
    return _totals(events.withWatermark(time, late), F.window(time, width), keys)


def sliding(events: DataFrame, time: str, width: str, step: str, late: str, *keys: str) -> DataFrame:
    """The same over overlapping windows."""
    return _totals(events.withWatermark(time, late), F.window(time, width, step), keys)


def _totals(events: DataFrame, window, keys) -> DataFrame:
    found = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of each key, ended by a gap."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedup_within_watermark(events: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key within the watermark; state of older keys is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def running_totals(events: DataFrame, key: str, kind: str, time: str, late: str, keep: int = 30 * 86_400_000) -> DataFrame:
    """Per key the number of rows and the sum of ``value`` so far, kept in custom state: a row per key and batch.

    The state of a key whose last row is ``keep`` milliseconds behind the watermark is dropped, so state does not grow for ever; the key then begins anew.
    """

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for part in parts:
            n, total, last = n + len(part), total + float(part["value"].sum()), max(last, int(part[time].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep)
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    grouped = events.withWatermark(time, late).select(key, time, "value").groupBy(key)
    return grouped.applyInPandasWithState(update, f"{key} {kind}, n bigint, total double", "n bigint, total double, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return all rows it gave (append), in a folder.

    The sink commits each batch once, so a run that is repeated after a failure gives no row twice.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is there now, giving each batch to a function (for update and complete modes)."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", scratch_path(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
