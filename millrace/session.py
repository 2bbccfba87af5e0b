"""Session settings and the shared folder for lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: The dialect: no ANSI errors, UTC, last map key wins, size(NULL) is NULL.
SQL_SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.legacy.sizeOfNull": "false",
}

#: Scale settings that an operator of a cluster may override at start.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app: str = "millrace", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=CLUSTER_SETTINGS | SQL_SETTINGS)
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Set the dialect on a session that someone else made."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once, unless PYTHONPATH lets them find it."""
    package = os.path.dirname(os.path.abspath(__file__))
    context = spark.sparkContext
    if os.path.dirname(package) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_millrace_sent", False):
        return
    folder = tempfile.TemporaryDirectory(prefix="millrace-")
    atexit.register(folder.cleanup)
    path = os.path.join(folder.name, "millrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._millrace_sent = True


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.TemporaryDirectory(prefix="millrace-")
        atexit.register(folder.cleanup)
        _own_dir.append(f"file://{folder.name}")
    return _own_dir[0]


_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; what is there is deleted at exit or by ``clear_scratch``."""
    if not _scratch:
        atexit.register(clear_scratch)
    path = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def clear_scratch() -> None:
    """Delete the written intermediate results of this process; DataFrames over them can no longer be read."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may have gone
            return


def stash(df: DataFrame, label: str = "stash") -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    Unlike a checkpoint the copy is columnar, so later reads prune columns, and
    it outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
