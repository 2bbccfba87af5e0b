"""The table directory: one parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> SparkSession:
    """Make tables visible to SQL under their names."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)
    return spark
