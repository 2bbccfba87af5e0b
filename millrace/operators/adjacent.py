"""The preceding row of each row, without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import stash


def _spread(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in ranges of (keys, order), with ``__task``, the range's number: written once, since a range must be the same wherever it is read."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stash(rows.repartitionByRange(tasks, *keys, *order).withColumn("__task", F.spark_partition_id()), "ranges")


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prefix + c`` for each ``c`` of ``carry``: its value in the key's preceding row by ``order``.

    The rows are range-partitioned by (keys, order), so a key that holds a large
    share of the rows spreads over many tasks. Inside a task a window gives the
    preceding row; the first row of a key in a task takes it from the last row of
    that key in an earlier task, found among one row per (task, key).

    The first row of a key gets nulls. Nulls in keys form a key; null order
    values come first. Rows equal in ``order`` follow each other in no fixed order.
    """
    spread = _spread(rows, keys, order)
    inside = Window.partitionBy("__task", *keys).orderBy(*order)
    carried = F.struct(*carry)
    near = spread.withColumn("__prev", F.lag(carried).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    last = near.groupBy("__task", *keys).agg(F.max_by(carried, F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__task")
    fills = last.select(
        F.col("__task").alias("__at"), *[F.col(k).alias(f"__key_{k}") for k in keys], F.lag("__last").over(across).alias("__before")
    ).where("__before IS NOT NULL")
    on = (F.col("__task") == F.col("__at")) & F.col("__first")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    joined = near.join(fills, on, "left").withColumn("__prev", F.coalesce("__prev", "__before"))
    return joined.select(*rows.columns, *[F.col(f"__prev.{c}").alias(prefix + c) for c in carry])


def with_previous_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], of: Column, prefix: str = "prev_") -> DataFrame:
    """As ``with_previous``, but from the nearest preceding row for which ``of`` holds."""
    spread = _spread(rows, keys, order)
    inside = Window.partitionBy("__task", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.when(of, F.struct(*carry))
    near = spread.withColumn("__prev", F.last(carried, ignorenulls=True).over(inside))
    last = near.groupBy("__task", *keys).agg(F.max_by(carried, F.when(of, F.struct(*order))).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    fills = last.select(
        F.col("__task").alias("__at"), *[F.col(k).alias(f"__key_{k}") for k in keys], F.last("__last", ignorenulls=True).over(across).alias("__before")
    ).where("__before IS NOT NULL")
    on = (F.col("__task") == F.col("__at")) & F.col("__prev").isNull()
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    joined = near.join(fills, on, "left").withColumn("__prev", F.coalesce("__prev", "__before"))
    return joined.select(*rows.columns, *[F.col(f"__prev.{c}").alias(prefix + c) for c in carry])
