"""Functions of the dialect that Spark does not name, as SQL functions that Catalyst inlines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: name -> (parameters, return type or None to infer, body)
EXTRAS: dict[str, tuple[str, str, str]] = {
    "add_years": ("d DATE, n INT", "DATE", "add_months(d, n * 12)"),
    "add_days": ("d DATE, n INT", "DATE", "date_add(d, n)"),
    "strpos": ("s STRING, part STRING", "INT", "instr(s, part)"),
    "array_contains_all": ("a ARRAY<INT>, b ARRAY<INT>", "BOOLEAN", "coalesce(size(array_except(b, a)) = 0, false)"),
    "deep_size": ("a ARRAY<ARRAY<INT>>", "INT", "size(flatten(a))"),
    "try_aes_encrypt": ("s STRING, k STRING", "BINARY", "CASE WHEN octet_length(k) IN (16, 24, 32) THEN aes_encrypt(s, rpad(k, 16, '0')) END"),
}


def install(spark: SparkSession) -> SparkSession:
    """Define the extra functions in the session, once."""
    for name, (parameters, returns, body) in EXTRAS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    spark.udf.register("random_poisson", F.pandas_udf(_poisson, "int").asNondeterministic())
    similar = similar_pattern_udf()
    spark.udf.register("similar_to", similar)
    return spark


def _poisson(mean: pd.Series, seed: pd.Series) -> pd.Series:
    import numpy as np

    if not len(mean):
        return pd.Series([], dtype="int32")
    first = int(seed.iloc[0])
    generator = _generators.setdefault(first, np.random.default_rng(first))
    return pd.Series(generator.poisson(mean.to_numpy(dtype="float64")).astype("int32"))


_generators: dict = {}


def similar_regex(pattern: str, escape: str | None = None) -> str:
    """A SIMILAR TO pattern as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i])
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def similar_to(column: Column, pattern: str, escape: str | None = None) -> Column:
    """SIMILAR TO with a literal pattern: stays inside the JVM."""
    return column.rlike(similar_regex(pattern, escape))


def similar_pattern_udf():
    """SIMILAR TO for SQL, where the pattern may be a column."""
    import re

    @F.pandas_udf("boolean")
    def run(values: pd.Series, patterns: pd.Series) -> pd.Series:
        compiled: dict[str, re.Pattern] = {}
        out = []
        for v, p in zip(values, patterns, strict=True):
            if v is None or p is None:
                out.append(None)
                continue
            if p not in compiled:
                compiled[p] = re.compile(similar_regex(p))
            out.append(compiled[p].match(v) is not None)
        return pd.Series(out, dtype="object")

    return run


def array_contains_all(a: Column, b: Column) -> Column:
    """Whether ``a`` holds every element of ``b``; NULL counts as no."""
    return F.coalesce(F.size(F.array_except(b, a)) == 0, F.lit(False))


def deep_size(nested: Column, depth: int) -> Column:
    """Number of leaves of an array nested ``depth`` levels deep."""
    for _ in range(depth - 1):
        nested = F.flatten(nested)
    return F.size(nested)


def element_at_strict(array: Column, index: Column) -> Column:
    """Like element_at, but an index outside the array is an error."""
    outside = (F.abs(index) > F.size(array)) | (index == 0)
    return F.when(outside, F.raise_error(F.lit("index out of bounds")).cast("string")).otherwise(F.try_element_at(array, index).cast("string"))


def try_aes_encrypt(data: Column, key: Column) -> Column:
    """aes_encrypt that gives NULL where the key has no valid length."""
    return F.when(F.octet_length(key).isin(16, 24, 32), F.aes_encrypt(data, key))
