"""Formats written and read again, write modes and row-level changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import dml
from millrace.session import scratch_path
from millrace.sources import formats
from millrace.sources.tables import load, register


def _trip(fmt: str, **options):
    def run(spark, folder):
        df = load(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
        path = scratch_path(spark, fmt)
        formats.write(df, fmt, path, **options)
        return formats.read(spark, fmt, path, None if fmt in ("parquet", "arrow", "orc") else df.schema, **options)

    run.__doc__ = f"A table through {fmt} files."
    return run


def _text(spark, folder):
    path = scratch_path(spark, "text")
    formats.write(load(spark, folder, "nation").select("n_name"), "text", path)
    return formats.read(spark, "text", path)


def _whole_text(spark, folder):
    path = scratch_path(spark, "text")
    formats.write(load(spark, folder, "region").select("r_name").coalesce(1), "text", path)
    return formats.read(spark, "text", path, wholetext=True).selectExpr("length(value) AS n")


def _partitioned(spark, folder):
    path = scratch_path(spark, "parts")
    formats.write(load(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "parquet", path, partition_by=["o_orderstatus"])
    return formats.read(spark, "parquet", path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


def _modes(spark, folder):
    path, df = scratch_path(spark, "modes"), load(spark, folder, "region")
    formats.write(df, "parquet", path)
    formats.write(df, "parquet", path, "append")
    formats.write(df, "parquet", path, "ignore")
    twice = formats.read(spark, "parquet", path).count()
    formats.write(df, "parquet", path, "overwrite")
    return formats.read(spark, "parquet", path).withColumn("appended", F.lit(twice))


def _glob(spark, folder):
    return formats.read(spark, "parquet", f"{folder}/{{region,regio?}}.parquet")


def _insert(spark, folder):
    name = "t" + scratch_path(spark, "x").rsplit("-", 1)[1][:12]
    register(spark, folder, "nation", "region")
    path = scratch_path(spark, "insert")
    spark.sql(f"CREATE TABLE {name} (k INT, s STRING) USING PARQUET LOCATION '{path}'")
    spark.sql(f"INSERT INTO {name} SELECT n_nationkey, n_name FROM nation")
    spark.sql(f"INSERT INTO {name} BY NAME SELECT r_name AS s, r_regionkey AS k FROM region")
    out = spark.read.parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return out


def _copy(spark, folder):
    path = scratch_path(spark, "dml")
    load(spark, folder, "nation").write.parquet(path)
    return path


def _delete(spark, folder):
    path = _copy(spark, folder)
    dml.delete(spark, path, F.col("n_regionkey") == 2)
    return spark.read.parquet(path)


def _update(spark, folder):
    path = _copy(spark, folder)
    dml.update(spark, path, {"n_name": F.upper("n_name")}, F.col("n_regionkey") == 1)
    return spark.read.parquet(path)


def _merge(spark, folder):
    path = _copy(spark, folder)
    changes = load(spark, folder, "nation").where("n_nationkey < 10").selectExpr("n_nationkey + 20 AS n_nationkey", "concat('new ', n_name) AS n_name", "n_regionkey", "n_nationkey = 3 AS gone")
    dml.merge(spark, path, changes, ["n_nationkey"], F.col("gone"))
    return spark.read.parquet(path)


def _replace_where(spark, folder):
    path = _copy(spark, folder)
    dml.replace_where(spark, path, load(spark, folder, "nation").where("n_nationkey = 0"), F.col("n_regionkey") == 0)
    return spark.read.parquet(path)


_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
QUERIES = {
    "file_csv": _trip("csv", header=True), "file_json": _trip("json"), "file_parquet": _trip("parquet", compression="zstd"), "file_orc": _trip("orc"), "file_arrow": _trip("arrow"), "file_text": _text, "file_whole_text": _whole_text,
    "file_partitioned": _partitioned, "file_modes": _modes, "file_glob": _glob, "insert_by_name": _insert, "dml_delete": _delete, "dml_update": _update, "dml_merge": _merge, "dml_replace_where": _replace_where,
}
ORACLES = {f"file_{f}": _ORDERS for f in ("csv", "json", "parquet", "orc", "arrow")} | {
    "file_text": "SELECT n_name AS value FROM nation", "file_whole_text": "SELECT (sum(length(r_name)) + count(*))::INT AS n FROM region", "file_partitioned": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "file_modes": "SELECT *, (SELECT 2 * count(*) FROM region)::INT AS appended FROM region", "file_glob": "SELECT * FROM region", "insert_by_name": "SELECT n_nationkey AS k, n_name AS s FROM nation UNION ALL SELECT r_regionkey, r_name FROM region",
    "dml_delete": "SELECT * FROM nation WHERE n_regionkey <> 2", "dml_update": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation",
    "dml_merge": "SELECT * FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey + 20, 'new ' || n_name, n_regionkey FROM nation WHERE n_nationkey < 10 AND n_nationkey <> 3",
    "dml_replace_where": "SELECT * FROM nation WHERE n_regionkey <> 0 OR n_nationkey = 0",
}
