"""Streaming operators over the events, split into files by time, against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.session import scratch_path
from millrace.sources.tables import load
from millrace.streaming import windows as ops


def _events(spark, folder, parts: int = 4, late: bool = True):
    """The events in batches by time: ``parts`` files one after the other, then (``late``) a file of
    the first five days again, far behind the watermark, and at last one event that moves the watermark past all others.
    """
    df = load(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    path = scratch_path(spark, "events")
    first, last = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.floor((F.unix_micros("ts") - first) * parts / (last - first + 1)), F.lit(parts - 1))
    for i in range(parts):
        df.where(part == i).coalesce(1).write.mode("append").parquet(path)
    if late:
        df.where(F.unix_micros("ts") < first + 5 * 86_400_000_000).coalesce(1).write.mode("append").parquet(path)
    end = spark.range(1).selectExpr("cast(-1 AS bigint) AS event_id", "timestamp'2034-01-01' AS ts", "cast(-1 AS bigint) AS user_id", "'end' AS event_type", "0.0D AS value")
    end.coalesce(1).write.mode("append").parquet(path)
    return ops.file_stream(spark, path, df.schema, 1)


def _plain(name):
    return F.col(name).cast("timestamp_ntz").alias(name)


def stream_tumbling(spark, folder):
    """Tumbling windows over five batches and a late one, whose rows are dropped."""
    out = ops.run_available(ops.tumbling(_events(spark, folder), "ts", "1 day", "5 days", "event_type"))
    return out.select(_plain("start"), "event_type", "n", F.round("total", 2).alias("total")).where("event_type <> 'end'")


def stream_sliding(spark, folder):
    """Sliding windows; late rows are dropped."""
    return ops.run_available(ops.sliding(_events(spark, folder), "ts", "2 days", "1 day", "5 days", "event_type")).select(_plain("start"), "event_type", "n").where("event_type <> 'end'")


def stream_sessions(spark, folder):
    """Sessions by user, across batches; late rows are dropped."""
    return ops.run_available(ops.sessions(_events(spark, folder), "ts", "6 hours", "5 days", "user_id")).where("user_id >= 0").select("user_id", _plain("start"), _plain("end"), "n")


def stream_dedup(spark, folder):
    """The first row per user within the watermark, which here spans all batches."""
    out = ops.run_available(ops.dedup_within_watermark(_events(spark, folder), "ts", "40 days", "user_id").select("user_id"))
    return out.where("user_id >= 0")


def stream_stateful(spark, folder):
    """Running totals in custom state over four batches: the last row per user, and how many batches gave one."""
    path = scratch_path(spark, "totals")
    totals = ops.running_totals(_events(spark, folder, late=False), "user_id", "bigint", "ts", "5 days")
    ops.run_batches(totals, "update", lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(path))
    return spark.read.parquet(path).where("user_id >= 0").groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 2).alias("total"), F.count("*").alias("batches"))


def batch_windows(spark, folder):
    """window, session_window and window_time over a table at rest."""
    df = load(spark, folder, "events").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return df.select(F.window_time("w").alias("at"), "n")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_dedup, stream_stateful, batch_windows)}
ORACLES = {
    "stream_tumbling": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts)::TIMESTAMP, (date_trunc('day', ts) - INTERVAL 1 DAY)::TIMESTAMP]) AS s FROM events) GROUP BY 1, 2",
    "stream_sessions": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM m)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, g""",
    "stream_dedup": "SELECT DISTINCT user_id FROM events",
    "stream_stateful": """WITH r AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events)
        SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT least(floor((epoch_us(ts) - a) * 4.0::DOUBLE / (b - a + 1)), 3)) AS batches FROM events, r GROUP BY 1""",
    "batch_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS at, count(*) AS n FROM events GROUP BY time_bucket(INTERVAL 1 DAY, ts)",
}
