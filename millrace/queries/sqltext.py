"""Queries given as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import register


def sql_query(tables: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs SQL over the named tables."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return register(spark, folder, *tables.split()).sql(text)

    run.__doc__ = f"SQL over {tables}."
    return run


def paired(entries: dict[str, tuple[str, str] | tuple[str, str, str]]) -> tuple[dict, dict]:
    """Queries and twins of (tables, SQL[, DuckDB SQL]) entries; one text serves both where no second is given."""
    return {n: sql_query(e[0], e[1]) for n, e in entries.items()}, {n: e[-1] for n, e in entries.items()}
