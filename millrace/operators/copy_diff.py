"""Differences between two copies of a dataset, field by field."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.presence import PresenceBitmap

#: Rows of both sides together that one group compares, about; bounds its memory, and spans several bitmap containers.
ROWS_PER_CHUNK = 1 << 17
LEFT_ONLY, RIGHT_ONLY = "only_source", "only_local"


def _differs(left: pa.ChunkedArray, right: pa.ChunkedArray, tolerance: float | None) -> np.ndarray:
    """Where two aligned columns differ; two nulls agree, two NaN agree."""
    lnull, rnull = left.is_null().to_numpy(zero_copy_only=False), right.is_null().to_numpy(zero_copy_only=False)
    if tolerance is None and not pa.types.is_floating(left.type):
        unequal = pc.fill_null(pc.not_equal(left, right), False)
        unequal = unequal.to_numpy(zero_copy_only=False) if isinstance(unequal, pa.Array) else unequal.to_numpy()
    else:
        a = pc.fill_null(left.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        b = pc.fill_null(right.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            near = (a == b) | (np.abs(a - b) <= (tolerance or 0.0)) | (np.isnan(a) & np.isnan(b))
        unequal = ~near
    return np.where(lnull | rnull, lnull != rnull, unequal.astype(bool))


def _ordinals(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """One number for each distinct key, whose parts the columns are, from 0."""
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        codes = (pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0)).dictionary_encode().indices.to_numpy()
        _, out = np.unique(out * (int(codes.max()) + 1 if len(codes) else 1) + codes, return_inverse=True)
    return out


def chunked(df: DataFrame, keys: Sequence[str], fields: Sequence[str], chunks: int) -> DataFrame:
    """One row of each key without nulls (k0.., f0..), with its chunk; as many partitions as chunks."""
    names = [f"k{i}" for i in range(len(keys))]
    kept = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]).dropna(subset=names)
    once = kept.dropDuplicates(names)
    return once.withColumn("chunk", F.pmod(F.xxhash64(*names), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")


def diff_copies(
    left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: dict[str, float] | None = None, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Rows that one copy lacks and, for rows in both, the fields whose values differ.

    Result: the keys and ``finding``: ``only_source``, ``only_local`` or a field's
    name. Both sides are hashed by key into chunks of about ``rows_per_chunk``
    rows (the number of chunks, and of tasks, follows the row count, so a large table or a hot
    key column cannot fill one group). In a chunk the keys of both sides get
    shared ordinals; presence bitmaps over them give missing rows by AND-NOT, and
    the rows of the intersection are compared column by column, aligned by ordinal.

    Rows with a null in a key are left out. Repeated rows of a key count once
    (they are taken to agree; any is compared) and are reduced to one, map side first, before chunks are made. Two nulls agree, a null and a
    value differ. Fields must have one type on both sides; other columns are not
    read. An empty side reports all rows of the other.
    """
    tolerance = tolerance or {}
    total = left.count() + right.count()
    chunks = max(1, -(-total // rows_per_chunk))

    a, b = chunked(left, keys, fields, chunks), chunked(right, keys, fields, chunks)
    for i, f in enumerate(fields):
        if a.schema[f"f{i}"].dataType != b.schema[f"f{i}"].dataType:
            raise TypeError(f"{f}: {a.schema[f'f{i}'].dataType} against {b.schema[f'f{i}'].dataType}")
    names = [f"k{i}" for i in range(len(keys))]
    key_types = [a.schema[f"k{i}"] for i in range(len(keys))]

    def compare(ltable: pa.Table, rtable: pa.Table) -> pa.Table:
        ordinals = _ordinals([pa.concat_tables([t.select([n]) for t in (ltable, rtable)])[n] for n in names])
        lord, rord = ordinals[: len(ltable)], ordinals[len(ltable) :]
        n = int(ordinals.max()) + 1 if len(ordinals) else 0
        lrow, rrow = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        lrow[lord], rrow[rord] = np.arange(len(lord)), np.arange(len(rord))
        lset, rset = PresenceBitmap.of(lord), PresenceBitmap.of(rord)
        both = lset.intersect(rset).to_array()
        found = [(ltable, lrow[lset.and_not(rset).to_array()], LEFT_ONLY), (rtable, rrow[rset.and_not(lset).to_array()], RIGHT_ONLY)]
        for i, field in enumerate(fields):
            at = _differs(ltable[f"f{i}"].take(pa.array(lrow[both])), rtable[f"f{i}"].take(pa.array(rrow[both])), tolerance.get(field))
            found.append((ltable, lrow[both[at]], field))
        parts = [t.select(names).take(pa.array(rows)).append_column("finding", pa.array([what] * len(rows), pa.string())) for t, rows, what in found]
        return pa.concat_tables([p.cast(pa.schema([(x, parts[0].schema.field(x).type) for x in [*names, "finding"]])) for p in parts])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_types) + ", finding string"
    pairs = a.groupBy("chunk").cogroup(b.groupBy("chunk")).applyInArrow(compare, schema)
    return pairs.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "finding")


def numeric_value(column: Column) -> Column:
    """A number written in any spelling, as a decimal; NULL where it is none."""
    return column.try_cast("decimal(38,18)")
