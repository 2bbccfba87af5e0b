"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one in SHARE of the rows; so at most SHARE keys are, which bounds the broadcast.
SHARE = 5_000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``counted`` (one row per key, with its number of rows in ``count``).

    Keys with more than total / SHARE rows, at most SHARE of them, are broadcast and
    their rows stay where they are; the others meet by a shuffle in which no
    key has more than that share. All rows come out, in either way.
    """
    line = max(1, total // SHARE)
    heavy = F.broadcast(counted.where(F.col(count) > line))
    light = counted.where(F.col(count) <= line)
    some = rows.join(heavy, key)
    rest = rows.join(heavy.select(key), key, "left_anti").join(light, key)
    return some.unionByName(rest)


#: Rows of a key list that may be broadcast.
SMALL_LIST = 10_000


def leave_out(rows: DataFrame, listed: DataFrame, key: str, small: int = SMALL_LIST) -> DataFrame:
    """``rows`` without the keys of ``listed`` (written already: it is counted); broadcast if it has at most ``small`` rows, else shuffled."""
    return rows.join(F.broadcast(listed) if listed.count() <= small else listed, key, "left_anti")


def join_listed(rows: DataFrame, counted: DataFrame, key: str, total: int, count: str = "n", small: int = SMALL_LIST) -> DataFrame:
    """``join_counted``, but a list (written already: it is counted) of at most ``small`` keys is broadcast whole."""
    if counted.count() <= small:
        return rows.join(F.broadcast(counted), key)
    return join_counted(rows, counted, key, total, count)
