"""The acceleration layer over the table folder, taken as a remote database."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.accel.dsn import Dsn
from millrace.accel.engine import Engine
from millrace.accel.remote import FolderSource
from millrace.session import scratch_path


def _engine(spark, folder, properties, name="shop", **more):
    engine = Engine(spark, scratch_path(spark, "engine").removeprefix("file://"), workers=2)
    tasks = engine.create_catalog(name, f"parquet://{folder}", properties, **more)
    failed = [t.error for t in engine.tasks.wait_for(tasks) if t.status != "completed"]
    if failed:
        raise RuntimeError(failed[0])
    return engine


_SELECT = {"cache_policy": "select", "table_set": "public.nation,public.region"}
_JOINED = "SELECT n_name, r_name FROM shop.public.nation JOIN shop.public.region ON n_regionkey = r_regionkey"


def cache_route(spark, folder):
    """A join answered from snapshots."""
    engine = _engine(spark, folder, _SELECT)
    try:
        return engine.sql(_JOINED)
    finally:
        engine.close()


def cache_live(spark, folder):
    """A table outside the policy is read live."""
    engine = _engine(spark, folder, _SELECT)
    try:
        return engine.sql("SELECT c_nationkey, count(*) AS n FROM shop.public.customer GROUP BY c_nationkey")
    finally:
        engine.close()


def cache_topk(spark, folder):
    """The tables that a top-k policy keeps, greatest first by rows and size."""
    engine = _engine(spark, folder, {"cache_policy": "topk", "k": "2"}, sync=False)
    try:
        star = [f"public.{t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")]
        from millrace.accel.remote import ranked

        return ranked(engine.source("shop").tables().where(F.col("table").isin(star)), 2).select("table", "row_count")
    finally:
        engine.close()


def cache_smart(spark, folder):
    """A smart policy keeps the top ten and the tables used of late."""
    engine = _engine(spark, folder, {}, sync=False)
    try:
        engine.table("shop.public.region")
        planned = engine.planned("shop")
        return spark.createDataFrame([("public.lineitem" in planned, "public.region" in planned, len(planned))], "top boolean, hot boolean, n int")
    finally:
        engine.close()


def cache_sql_stats(spark, folder):
    """Two spellings of a statement are one; the second is answered from the cached result."""
    engine = _engine(spark, folder, _SELECT)
    try:
        engine.sql(_JOINED)
        engine.sql(_JOINED.replace("SELECT", "select").replace(" FROM", "\n  from"))
        return engine.sql_stats().select("count", F.lit(engine.hits).alias("hits"))
    finally:
        engine.close()


def cache_table_stats(spark, folder):
    """Uses of tables are counted."""
    engine = _engine(spark, folder, _SELECT)
    try:
        for _ in range(3):
            engine.table("shop.public.nation")
        return engine.table_stats().select("catalog", "table", "query_count")
    finally:
        engine.close()


def cache_refresh(spark, folder):
    """An incremental refresh equals the live table, and the earlier version can still be read."""
    engine = _engine(spark, folder, _SELECT, sync=False)
    try:
        live = engine.source("shop").read("public.nation")
        stamped = live.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
        later = stamped.where("n_nationkey < 5").withColumns({"n_name": F.upper("n_name"), "updated_at": F.lit("2024-02-01").cast("timestamp_ntz")})
        base = scratch_path(spark, "remote").removeprefix("file://")
        stamped.write.parquet(f"{base}/nation.parquet")
        source = FolderSource(spark, Dsn.parse(f"parquet://{base}"), {"public.nation": ["n_nationkey"]})
        name = "r" + uuid.uuid4().hex[:8]
        engine.create_catalog(name, f"parquet://{base}", {"cache_policy": "select", "table_set": "public.nation"}, sync=False, source=source)
        engine.snapshot(name, "public.nation")
        moved = f"{base}-2"
        stamped.where("n_nationkey >= 5").unionByName(later).write.parquet(f"{moved}/nation.parquet")
        source.folder = moved
        engine.refresh(name, "public.nation")
        made = engine.store.snapshots(name, "public.nation")[1]["at"]
        return engine.sql(f"SELECT 'now' AS at, n_nationkey, n_name FROM {name}.public.nation TIMESTAMP AS OF '{made}' UNION ALL SELECT 'before', n_nationkey, n_name FROM {name}.public.nation VERSION AS OF 1")
    finally:
        engine.close()


QUERIES = {f.__name__: f for f in (cache_route, cache_live, cache_topk, cache_smart, cache_sql_stats, cache_table_stats, cache_refresh)}
ORACLES = {
    "cache_route": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "cache_live": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1",
    "cache_topk": "SELECT 'public.lineitem' AS \"table\", count(*) AS row_count FROM lineitem UNION ALL SELECT 'public.orders', count(*) FROM orders",
    "cache_smart": "SELECT true AS top, true AS hot, 11 AS n",
    "cache_sql_stats": "SELECT 2 AS count, 1 AS hits",
    "cache_table_stats": "SELECT 'shop' AS catalog, 'public.nation' AS \"table\", 3 AS query_count",
    "cache_refresh": "SELECT 'before' AS at, n_nationkey, n_name FROM nation UNION ALL SELECT 'now', n_nationkey, CASE WHEN n_nationkey < 5 THEN upper(n_name) ELSE n_name END FROM nation",
}
