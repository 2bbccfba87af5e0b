"""Merge, update, delete and conditional overwrite of parquet folders: copy on write, published by rename."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns by which a folder is partitioned, outermost first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, found = hadoop.Path(path), []
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    while True:
        below = next((s.getPath() for s in fs.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()), None)
        if below is None:
            return found
        found.append(below.getName().split("=")[0])
        at = below


def _publish(df: DataFrame, path: str) -> None:
    """Write the new content aside under the folder's partitioning, move the old away, move the new in.

    Between the two moves, of a moment, a reader finds no folder.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, aside, old = hadoop.Path(path), hadoop.Path(f"{path}.new-{uuid.uuid4().hex}"), hadoop.Path(f"{path}.old-{uuid.uuid4().hex}")
    df.write.partitionBy(*partition_columns(spark, path)).parquet(aside.toString())
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(final, old):
        raise RuntimeError(f"{path} could not be moved")
    if not fs.rename(aside, final):
        fs.rename(old, final)
        raise RuntimeError(f"{path} could not be replaced")
    fs.delete(old, True)


def delete(spark: SparkSession, path: str, condition: Column) -> None:
    """Remove the rows for which the condition is true (not those where it is NULL)."""
    _publish(spark.read.parquet(path).where(~F.coalesce(condition, F.lit(False))), path)


def update(spark: SparkSession, path: str, values: dict[str, Column], condition: Column) -> None:
    """Set columns in the rows for which the condition is true."""
    df = spark.read.parquet(path)
    hit = F.coalesce(condition, F.lit(False))
    _publish(df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns]), path)


def merge(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], deleted: Column | None = None) -> None:
    """Upsert ``changes`` (a row per key, columns of the table, plus any used by ``deleted``) and remove keys marked deleted."""
    _publish(merged(spark.read.parquet(path), changes, keys, deleted), path)


def merged(table: DataFrame, changes: DataFrame, keys: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """The table after an upsert: rows not in ``changes``, and the changes themselves; no full outer join is needed. Two changes of one key are refused."""
    if changes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"several changes of one key {list(keys)}")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}"))
    kept = table.alias("t").join(changes.select(*keys).alias("c"), on, "left_anti")
    fresh = changes.where(~F.coalesce(deleted, F.lit(False))) if deleted is not None else changes
    return kept.unionByName(fresh.select(*table.columns))


def replace_where(spark: SparkSession, path: str, rows: DataFrame, condition: Column) -> None:
    """Overwrite the rows under a condition by others."""
    table = spark.read.parquet(path)
    _publish(table.where(~F.coalesce(condition, F.lit(False))).unionByName(rows), path)
