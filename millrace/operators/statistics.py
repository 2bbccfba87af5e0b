"""Missing values and statistics over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_null(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill NULL only (NaN stays), in columns of the value's kind; one column expression each, no extra pass."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double") if number else ("boolean",) if isinstance(value, bool) else ("string",)
    chosen = [c for c, t in df.dtypes if (columns is None or c in columns) and (t in kinds or number and t.startswith("decimal"))]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType)) for c in chosen}) if chosen else df


def drop_missing(df: DataFrame, threshold: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least ``threshold`` (default all) values that are neither NULL nor NaN."""
    return df.na.drop(thresh=threshold, subset=list(columns) if columns else None) if threshold else df.na.drop(subset=list(columns) if columns else None)


def crosstab(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    """Counts of pairs of values, a row per ``a`` and a column per ``b``; values of b may be given to spare a pass. NULLs of either are left out."""
    kept = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return kept.groupBy(F.col(a).cast("string").alias(f"{a}_{b}")).pivot(b, list(values) if values else None).agg(F.count(F.lit(1))).na.fill(0)


def summary(df: DataFrame, columns: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75), exact: bool = False) -> DataFrame:
    """A row per statistic (in a fixed order) and a column per column, as text; one aggregation over the table."""
    quantile = F.percentile if exact else F.percentile_approx
    rows: list[tuple[str, callable]] = [("count", F.count), ("mean", F.mean), ("stddev", F.stddev), ("min", F.min)]
    rows += [(f"{p:.0%}", lambda c, p=p: quantile(c, F.lit(p))) for p in percentiles] + [("max", F.max)]
    flat = df.agg(*[f(F.col(c)).cast("string").alias(f"{i}_{c}") for i, (_, f) in enumerate(rows) for c in columns])
    parts = [F.struct(F.lit(name).alias("summary"), *[F.col(f"{i}_{c}").alias(c) for c in columns]) for i, (name, _) in enumerate(rows)]
    return flat.select(F.inline(F.array(*parts)))


def sample_by(df: DataFrame, column: str, fractions: dict, seed: int) -> DataFrame:
    """A share of the rows of each stratum; strata not named are left out."""
    return df.stat.sampleBy(column, fractions, seed)


def replace_values(df: DataFrame, mapping: dict, columns: Sequence[str]) -> DataFrame:
    """Replace values in columns; one CASE each."""

    def replaced(c: str) -> Column:
        cases = reduce(lambda acc, kv: acc.when(F.col(c) == F.lit(kv[0]), F.lit(kv[1])), mapping.items(), F)
        return cases.otherwise(F.col(c)).alias(c)

    return df.select(*[replaced(c) if c in columns else F.col(c) for c in df.columns])


def frequent_items(df: DataFrame, column: str, support: float) -> DataFrame:
    """Values held by at least ``support`` of the rows, exactly, with their counts; aggregated with partial counts."""
    total = df.select(F.count("*").alias("total"))
    return df.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * support).drop("total")


def schema_pivot(df: DataFrame, key: str) -> DataFrame:
    """Every column as rows of (key, column name, value as text)."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, *[F.col(c).cast("string") for c in rest]).unpivot(key, rest, "column_name", "value")
