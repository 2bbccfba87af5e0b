"""Relational operators that Spark lacks or names otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.adjacent import with_previous_of


def right_semi(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """Rows of ``right`` with a match in ``left``: sides swapped, so it plans as a left semi join."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """Rows of ``right`` without a match in ``left``."""
    return right.join(left, on, "left_anti")


def join_with(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A join whose rows hold each side as one struct: left, right (null where a side is missing)."""
    a = left.select(F.struct(*left.columns).alias("left"), *left.columns).alias("l")
    b = right.select(F.struct(*right.columns).alias("right"), *right.columns).alias("r")
    return a.join(b, on, how).select("left", "right")


def tail(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The last ``n`` rows by an order, in that order; a bounded top-k of the reverse, never a full sort or count."""
    backward = [_reverse(o) for o in order]
    return df.orderBy(*backward).limit(n).orderBy(*order)


def _reverse(order: Column) -> Column:
    text = order._jc.toString()
    expression = F.expr(text.rsplit(" ASC ", 1)[0].rsplit(" DESC ", 1)[0])
    return expression.asc_nulls_first() if " DESC" in text and "NULLS LAST" in text else expression.asc_nulls_last() if " DESC" in text else expression.desc_nulls_first() if "NULLS LAST" in text else expression.desc_nulls_last()


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key by ``order``: an aggregation with partial results, not a window, so a hot key is no hot task."""
    values = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("picked"))
    return picked.select(*keys, *[F.col(f"picked.{v}") for v in values]).select(*df.columns)


def range_frame(spark: SparkSession, start: int, end: int | None = None, step: int = 1, parts: int | None = None) -> DataFrame:
    """Numbers from start (0 if only one bound is given) up to the end, exclusive; step 0 is refused."""
    if step == 0:
        raise ValueError("step must not be 0")
    low, high = (0, start) if end is None else (start, end)
    return spark.range(low, high, step, parts)


def cluster_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of equal columns together and sorted in each partition."""
    return df.repartition(*columns).sortWithinPartitions(*columns)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int, how: str = "inner") -> DataFrame:
    """Equi-join in which each key of the left spreads over ``salts`` tasks; the right is repeated that often. Inner, left, semi and anti only."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} would repeat unmatched rows of the right")
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(F.struct(*left.columns)), F.lit(salts)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "__salt"], how).drop("__salt")


#: Buckets that a span touches at most, about; a longer one goes to a level of wider buckets.
BUCKETS_PER_SPAN = 64


def interval_join(points: DataFrame, spans: DataFrame, point: str, begin: str, end: str, width: float) -> DataFrame:
    """Pairs of points and spans with begin <= point < end (numbers of any kind): an equi-join on buckets of ``width``, not a nested loop.

    Choose ``width`` near the spans' usual length. Spans are repeated for each bucket they touch; one of more than
    BUCKETS_PER_SPAN buckets goes to a level of buckets that many times as wide, and so on, and points are repeated for each level (found by
    the greatest length). A bucket that holds very many rows is split by adaptive execution. Nulls and empty spans match nothing; equal rows stay.
    """
    spans = spans.where(F.col(begin) < F.col(end))
    length = (F.col(end).cast("double") - F.col(begin).cast("double")) / width
    level = F.greatest(F.lit(0), F.ceil(F.log(float(BUCKETS_PER_SPAN), F.greatest(length, F.lit(1.0)))) - 1).cast("int")
    top = spans.agg(F.max(level)).first()[0] or 0
    wide = lambda c, at: F.floor(F.col(c).cast("double") / (F.pow(F.lit(float(BUCKETS_PER_SPAN)), at) * width))
    p = points.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("__bucket", wide(point, F.col("__level")))
    s = spans.withColumn("__level", level).withColumn("__bucket", F.explode(F.sequence(wide(begin, F.col("__level")), wide(end, F.col("__level")))))
    return p.join(s, ["__level", "__bucket"]).where((F.col(point) >= F.col(begin)) & (F.col(point) < F.col(end))).drop("__level", "__bucket")


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the ``values`` of the latest right row of its key at or before its time: sorted ranges of the union, no range join.

    The rows are ranged by key and time, so a key that holds a large share of them spreads over tasks; the last right
    row is carried from task to task. Null keys equal each other, null times match nothing. Of right rows of one key and time any counts.
    """
    a = left.withColumns({"__time": F.col(left_time), "__side": F.lit(1), "__held": F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)})
    b = right.where(F.col(right_time).isNotNull()).select(*on, F.col(right_time).alias("__time"), F.struct(*values).alias("__held"), F.lit(0).alias("__side"))
    both = with_previous_of(a.unionByName(b, allowMissingColumns=True), on, ["__time", "__side"], ["__held"], F.col("__side") == 0, "__last")
    last = F.when(F.col("__time").isNotNull(), F.col("__last__held"))
    return both.where("__side = 1").select(*left.columns, *[last[v].alias(v) for v in values])


def star(df: DataFrame, ilike: str | None = None, exclude: Sequence[str] = (), replace: dict[str, Column] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """All columns, with options: only names like a pattern (% and _), without some, some computed anew, some renamed."""
    import re

    out, gone = [], {c.lower() for c in exclude}
    pattern = re.compile("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in ilike), re.I) if ilike else None
    for c in df.columns:
        if c.lower() in gone or pattern and not pattern.fullmatch(c):
            continue
        out.append((replace or {}).get(c, F.col(c)).alias((rename or {}).get(c, c)))
    return df.select(*out)


def show_string(df: DataFrame, rows: int = 20, truncate: int = 20, vertical: bool = False) -> str:
    """The table that ``show`` prints."""
    return df._jdf.showString(rows, truncate, vertical)
