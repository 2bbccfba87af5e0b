"""Content hashes and text rules shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(columns: Sequence[Column]) -> Column:
    """64-bit hash of a row's values in which NULL differs from every value.

    xxhash64 skips NULLs, so (NULL, 1) and (1, NULL) would agree; each value is
    therefore preceded by whether it is NULL.
    """
    parts: list[Column] = []
    for c in columns:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def text_value(column: Column) -> Column:
    """Text as compared between copies: blanks (U+0020) at the end do not count."""
    return F.rtrim(column)


def utc_naive(column: Column) -> Column:
    """An instant as the naive UTC time it denotes, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz"))
