"""Only new or changed records: keyed content-hash state with atomic versions."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.hashing import content_hash
from millrace.session import stash

HASH = "__content_hash"


@dataclass(frozen=True)
class ChangeState:
    """Versioned state (keys, content hash) of what was processed, under ``path``.

    A version is a parquet folder ``v<N>-<id>``; it counts once a file
    ``commits/<N>`` naming it exists. That file is written aside and then given its name,
    which fails if the name is taken (HDFS refuses such a rename, a local disk such a link), so a version becomes visible at
    once or not at all. A run swaps from the version that it read: of two runs that read the same
    one, the second is refused, and its records come out again next time. A run
    that dies before leaves the old version in force: none of its records is skipped.
    File systems that neither refuse to rename onto a file nor are local are not fit.

    Nulls in keys equal each other; null values differ from every value. An
    absent state is an empty one.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The committed version; 0 if there is none."""
        hadoop, fs = self._fs()
        folder = hadoop.Path(f"{self.path}/commits")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _folder(self, version: int) -> str:
        hadoop, fs = self._fs()
        stream = fs.open(hadoop.Path(f"{self.path}/commits/{version}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def read(self) -> tuple[int, DataFrame | None]:
        """The committed version and its state; (0, None) if there is none."""
        version = self.version()
        return version, self.spark.read.parquet(f"{self.path}/{self._folder(version)}") if version else None

    def swap(self, state: DataFrame, expected: int) -> int:
        """Write ``state`` aside and make it the version after ``expected``, the one it was made from; returns its number."""
        folder = f"v{expected + 1}-{uuid.uuid4().hex}"
        state.write.parquet(f"{self.path}/{folder}")
        hadoop, fs = self._fs()
        aside, final = hadoop.Path(f"{self.path}/pending/{folder}"), hadoop.Path(f"{self.path}/commits/{expected + 1}")
        fs.mkdirs(final.getParent())
        stream = fs.create(aside, False)
        stream.writeUTF(folder)
        stream.close()
        if not self._claim(fs, aside, final):
            fs.delete(hadoop.Path(f"{self.path}/{folder}"), True)
            raise RuntimeError(f"version {expected + 1} was committed by another run")
        return expected + 1

    @staticmethod
    def _claim(fs, aside, final) -> bool:
        """Give a file its name unless that is taken; one step, in which of several only one succeeds."""
        if fs.getScheme() != "file":
            return fs.rename(aside, final)
        try:
            os.link(aside.toUri().getPath(), final.toUri().getPath())
        except FileExistsError:
            return False
        return True

    def run(self, current: DataFrame, process: Callable[[DataFrame], DataFrame | None] | None = None) -> DataFrame:
        """One run: the new or changed rows of ``current`` (keys, content hash, each key once), after the state has been swapped.

        The rows are written down and given to ``process`` before the swap: if it raises, or the run dies, the
        state stays and the rows come out again next time.
        """
        version, old = self.read()
        current = stash(current, "current")
        found = stash(detect(current, old, self.keys), "changes")
        if process:
            process(found)
        self.swap(current, version)
        return found

    def prune(self, keep: int = 2) -> int:
        """Delete the states of all but the newest ``keep`` versions; returns how many."""
        hadoop, fs = self._fs()
        gone = [n for n in range(1, self.version() - keep + 1) if fs.exists(hadoop.Path(f"{self.path}/{self._folder(n)}"))]
        for n in gone:
            fs.delete(hadoop.Path(f"{self.path}/{self._folder(n)}"), True)
        return len(gone)


def hashed(rows: DataFrame, keys: Sequence[str], values: Sequence[str | Column]) -> DataFrame:
    """Keys and content hash of each row."""
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    return rows.select(*keys, content_hash(columns).alias(HASH))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], carry: Column, name: str) -> DataFrame:
    """Per key the ``carry`` of the row that is greatest by ``order``.

    One aggregation with partial sums on the map side, so a key that holds a
    large share of the rows costs one row per task. Rows equal in ``order`` are
    told apart by ``carry``, so the result does not depend on the row order.
    """
    picked = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], carry.alias("carry")))
    return rows.groupBy(*keys).agg(picked.alias("picked")).select(*keys, F.col("picked.carry").alias(name))


def detect(current: DataFrame, state: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows of ``current`` (keys, hash) that the state lacks or holds with another hash.

    Adds ``change``: ``new`` or ``changed``. ``current`` must hold a key once.
    """
    if state is None:
        return current.withColumn("change", F.lit("new"))
    old = state.select(*[F.col(k).alias(f"__state_{k}") for k in keys], F.col(HASH).alias("__state_hash"))
    on = [F.col(k).eqNullSafe(F.col(f"__state_{k}")) for k in keys]
    joined = current.join(old, on, "left")
    changed = joined.where(F.col("__state_hash").isNull() | (F.col("__state_hash") != F.col(HASH)))
    kind = F.when(F.col("__state_hash").isNull(), "new").otherwise("changed")
    return changed.select(*current.columns, kind.alias("change"))
