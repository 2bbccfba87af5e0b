"""What changed between consecutive full snapshots: gaps and islands over key and row hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.hashing import content_hash
from millrace.operators.heavy import SMALL_LIST
from millrace.session import stash


def intervals(snapshots: DataFrame, series: str, number: str, keys: Sequence[str], values: Sequence[Column], latest_by: str) -> DataFrame:
    """Validity intervals of each record: series, keys, first_idx, last_idx and last_of_series.

    Snapshots of a series are numbered densely over the numbers present; if one
    holds a record several times, the row with the greatest ``latest_by`` counts.
    An interval is a run of consecutive snapshots in which the record is present
    with one content. All windows run per record (bounded by the number of
    snapshots), after one shuffle by (series, keys).

    Rows with a null key are left out. Null values equal each other only.
    """
    dense = numbered(snapshots, series, number)
    return _intervals(snapshots, dense, series, number, keys, values, latest_by)


def numbered(snapshots: DataFrame, series: str, number: str) -> DataFrame:
    """The snapshots of each series, numbered densely: series, number, idx, last_of_series.

    A row per snapshot, written once; broadcast where it is joined if it has at most SMALL_LIST rows.
    """
    by_series = Window.partitionBy(series)
    dense = snapshots.select(series, number).distinct().select(
        series, number, F.row_number().over(by_series.orderBy(number)).alias("idx"), F.count("*").over(by_series).alias("last_of_series")
    )
    dense = stash(dense, "numbers")
    return F.broadcast(dense) if dense.count() <= SMALL_LIST else dense


def _intervals(snapshots: DataFrame, dense: DataFrame, series: str, number: str, keys: Sequence[str], values: Sequence[Column], latest_by: str) -> DataFrame:
    record = [series, *keys]
    held = (
        snapshots.dropna(subset=list(keys))
        .select(series, number, *keys, F.struct(F.col(latest_by), content_hash(values).alias("hash")).alias("held"))
        .repartition(*record)
        .groupBy(series, *keys, number)
        .agg(F.max("held").alias("held"))
        .join(dense, [series, number])
        .select(*record, "idx", "last_of_series", F.col("held.hash").alias("hash"))
    )
    island = F.col("idx") - F.row_number().over(Window.partitionBy(*record, "hash").orderBy("idx"))
    runs = held.withColumn("island", island).groupBy(*record, "hash", "island")
    return runs.agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.max("last_of_series").alias("last_of_series"))


def change_events(snapshots: DataFrame, series: str, number: str, keys: Sequence[str], values: Sequence[Column], latest_by: str) -> DataFrame:
    """Changes between consecutive snapshots: series, ``number`` (the later's), keys, change.

    An interval that starts where the record's previous one ends is ``changed``; one that
    starts otherwise, after the series' first snapshot, is ``added``; the end of an
    interval that no other follows at once, before the last snapshot, is
    ``removed`` in the next snapshot. Empty tables give no rows.
    """
    dense = numbered(snapshots, series, number)
    spans = _intervals(snapshots, dense, series, number, keys, values, latest_by)
    along = Window.partitionBy(series, *keys).orderBy("first_idx")
    seen = spans.withColumn("before", F.lag("last_idx").over(along)).withColumn("after", F.lead("first_idx").over(along))
    start = F.when(F.col("first_idx") > 1, F.struct(F.col("first_idx").alias("idx"), F.when(F.col("before") == F.col("first_idx") - 1, "changed").otherwise("added").alias("change")))
    gone = (F.col("last_idx") < F.col("last_of_series")) & ~F.coalesce(F.col("after") == F.col("last_idx") + 1, F.lit(False))
    end = F.when(gone, F.struct((F.col("last_idx") + 1).alias("idx"), F.lit("removed").alias("change")))
    events = seen.select(series, *keys, F.explode(F.array_compact(F.array(start, end))).alias("e")).select(series, *keys, "e.*")
    return events.join(dense.drop("last_of_series"), [series, "idx"]).select(series, number, *keys, "change")
