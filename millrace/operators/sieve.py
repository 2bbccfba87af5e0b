"""A Bloom filter of bounded size, to leave rows out before a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bits of a filter: 8 MB, however many keys there are. More keys only let more rows through.
MOST_BITS = 1 << 26
BITS_A_KEY = 16


def key_hash(key: Column) -> Column:
    """The hash by which the filter knows a key."""
    return F.xxhash64(key)


class Sieve:
    """Membership by two bits of a key's hash: never misses a member, may let others pass."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, keys: DataFrame, key: str, count: int) -> Sieve:
        """Build from distinct keys: bitmaps are aggregated in Spark, at most MOST_BITS / 8 bytes come to the driver."""
        bits = 1 << 15
        while bits < min(MOST_BITS, BITS_A_KEY * count):
            bits *= 2
        h = key_hash(F.col(key))
        low, high = h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))
        spots = keys.select(F.explode(F.array(low + 1, high + 1)).alias("p"))
        parts = spots.groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
        words = np.zeros(bits // 8, dtype=np.uint8)
        for row in parts.toLocalIterator():
            words[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(bytes(row.m), dtype=np.uint8)
        return cls(bits, words)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may be members."""
        h = hashes.view(np.uint64)
        mask = np.uint64(self.bits - 1)
        out = np.ones(len(h), dtype=bool)
        for p in (h & mask, (h >> np.uint64(32)) & mask):
            out &= (self.words[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def send(self, df: DataFrame) -> Broadcast:
        """To every task."""
        return df.sparkSession.sparkContext.broadcast(self)
