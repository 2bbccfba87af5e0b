"""Expressions in SQL syntax, catalog commands and table writes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import relational as ops
from millrace.queries.sqltext import paired
from millrace.session import scratch_path
from millrace.sources.sinks import TableWriter, drop
from millrace.sources.tables import load, register


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


def _kept(spark, table: str):
    """A table's rows under a plan that no longer needs the table."""
    path = scratch_path(spark, "kept")
    spark.table(table).write.parquet(path)
    drop(spark, table)
    return spark.read.parquet(path)


def star_options(spark, folder):
    """ILIKE, EXCLUDE, REPLACE and RENAME of a star."""
    return ops.star(load(spark, folder, "nation"), ilike="N_%", exclude=["n_regionkey"], replace={"n_name": F.upper("n_name")}, rename={"n_nationkey": "key"})


def struct_update(spark, folder):
    """Fields of a struct set and dropped."""
    s = F.struct(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b"))
    return load(spark, folder, "nation").select(s.withField("c", F.lit(1)).dropFields("b").alias("s")).select("s.a", "s.c")


def alias_metadata(spark, folder):
    """An alias keeps its metadata."""
    df = load(spark, folder, "region").select(F.col("r_name").alias("name", metadata={"unit": "none"}))
    return df.withColumn("unit", F.lit(df.schema["name"].metadata["unit"]))


def parameters_by_place(spark, folder):
    """Parameters by place."""
    return register(spark, folder, "orders").sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", args=["O", 450000.0])


def create_table_as(spark, folder):
    """CREATE TABLE AS SELECT."""
    t = _name("ctas")
    register(spark, folder, "nation").sql(f"CREATE TABLE {t} USING PARQUET LOCATION '{scratch_path(spark, t)}' AS SELECT n_nationkey, n_name FROM nation")
    return _kept(spark, t)


def insert_overwrite(spark, folder):
    """INSERT OVERWRITE replaces all rows."""
    t = _name("over")
    register(spark, folder, "nation", "region").sql(f"CREATE TABLE {t} (k INT, s STRING) USING PARQUET LOCATION '{scratch_path(spark, t)}'")
    spark.sql(f"INSERT INTO {t} SELECT n_nationkey, n_name FROM nation")
    spark.sql(f"INSERT OVERWRITE {t} SELECT r_regionkey, r_name FROM region")
    return _kept(spark, t)


def insert_columns(spark, folder):
    """INSERT with a column list."""
    t = _name("cols")
    register(spark, folder, "region").sql(f"CREATE TABLE {t} (k INT, s STRING) USING PARQUET LOCATION '{scratch_path(spark, t)}'")
    spark.sql(f"INSERT INTO {t} (s, k) SELECT r_name, r_regionkey FROM region")
    return _kept(spark, t)


def insert_directory(spark, folder):
    """INSERT OVERWRITE DIRECTORY."""
    path = scratch_path(spark, "dir")
    register(spark, folder, "region").sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING PARQUET SELECT * FROM region")
    return spark.read.parquet(path)


def write_append(spark, folder):
    """Append by name to a table."""
    t, df = _name("app"), load(spark, folder, "region")
    df.write.option("path", scratch_path(spark, t)).saveAsTable(t)
    TableWriter(df.select("r_name", "r_regionkey"), t).append()
    return _kept(spark, t)


def write_overwrite_partitions(spark, folder):
    """Partitions with new rows are replaced, others stay."""
    t, df = _name("parts"), load(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    df.write.option("path", scratch_path(spark, t)).partitionBy("n_regionkey").saveAsTable(t)
    TableWriter(df.where("n_regionkey = 1").withColumn("n_name", F.lit("new")), t).overwrite_partitions()
    return _kept(spark, t)


def write_overwrite_where(spark, folder):
    """Rows under a condition are replaced."""
    t, df = _name("cond"), load(spark, folder, "nation")
    df.write.option("path", scratch_path(spark, t)).saveAsTable(t)
    TableWriter(df.where("n_nationkey = 0"), t).overwrite(F.col("n_regionkey") < 3)
    return _kept(spark, t)


def write_buckets(spark, folder):
    """A table in buckets, sorted in each: joins on its key need no shuffle."""
    t, df = _name("buck"), load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    df.write.option("path", scratch_path(spark, t)).bucketBy(4, "o_custkey").sortBy("o_custkey").saveAsTable(t)
    return _kept(spark, t)


def catalog_commands(spark, folder):
    """CREATE, SHOW, USE, DESCRIBE, COMMENT, ALTER and DROP, with what they list."""
    db, said = _name("db"), []
    try:
        spark.sql(f"CREATE DATABASE {db} LOCATION '{scratch_path(spark, db)}'")
        said.append(("databases", spark.sql(f"SHOW DATABASES LIKE '{db}'").count()))
        spark.sql(f"CREATE TABLE {db}.t (k INT COMMENT 'key', s STRING) USING PARQUET TBLPROPERTIES ('a' = 'b')")
        said.append(("tables", spark.sql(f"SHOW TABLES IN {db}").where("isTemporary = false").count()))
        said.append(("columns", spark.sql(f"SHOW COLUMNS IN {db}.t").count()))
        spark.sql(f"COMMENT ON TABLE {db}.t IS 'rows'")
        spark.sql(f"ALTER TABLE {db}.t ADD COLUMNS (d DATE)")
        said.append(("after alter", len(spark.table(f"{db}.t").columns)))
        spark.sql(f"CREATE VIEW {db}.v AS SELECT k FROM {db}.t")
        said.append(("views", spark.sql(f"SHOW VIEWS IN {db}").where("isTemporary = false").count()))
        spark.sql(f"CREATE TABLE {db}.u LIKE {db}.t")
        said.append(("like", len(spark.table(f"{db}.u").columns)))
        said.append(("properties", spark.sql(f"SHOW TBLPROPERTIES {db}.t ('a')").count()))
        spark.sql(f"CACHE TABLE {db}.t")
        said.append(("cached", int(spark.catalog.isCached(f"{db}.t"))))
        spark.sql(f"UNCACHE TABLE {db}.t")
        spark.sql(f"REFRESH TABLE {db}.t")
        spark.sql(f"ANALYZE TABLE {db}.t COMPUTE STATISTICS")
        said.append(("create", int("CREATE TABLE" in spark.sql(f"SHOW CREATE TABLE {db}.t").first()[0])))
        said.append(("explain", int("Physical Plan" in spark.sql(f"EXPLAIN SELECT * FROM {db}.t").first()[0])))
        spark.sql(f"DROP VIEW {db}.v")
        spark.sql(f"DROP TABLE {db}.u PURGE")
        said.append(("left", spark.sql(f"SHOW TABLES IN {db}").where("isTemporary = false").count()))
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
    return spark.createDataFrame(said, "what string, n int")


def temp_views(spark, folder):
    """Temporary and global temporary views."""
    v = _name("v")
    load(spark, folder, "region").createOrReplaceTempView(v)
    spark.sql(f"CREATE OR REPLACE GLOBAL TEMPORARY VIEW {v}_g AS SELECT r_regionkey FROM {v}")
    return spark.sql(f"SELECT a.r_name, b.r_regionkey FROM {v} a JOIN global_temp.{v}_g b USING (r_regionkey)")


_SQL = {
    "sql_syntax": ("orders", "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, SUBSTRING(o_orderpriority FROM 3 FOR 2) AS s, TRIM(LEADING '1' FROM o_orderpriority) AS l, TRIM(TRAILING 'H' FROM o_orderpriority) AS t, OVERLAY(o_orderpriority PLACING 'x' FROM 1 FOR 2) AS o, POSITION('-' IN o_orderpriority) AS p, CAST(o_totalprice AS INT) AS c, o_orderkey::STRING AS k FROM orders",
        "SELECT o_orderkey, year(o_orderdate)::INT AS y, substr(o_orderpriority, 3, 2) AS s, ltrim(o_orderpriority, '1') AS l, rtrim(o_orderpriority, 'H') AS t, 'x' || substr(o_orderpriority, 3) AS o, instr(o_orderpriority, '-')::INT AS p, trunc(o_totalprice)::INT AS c, o_orderkey::VARCHAR AS k FROM orders"),
    "sql_named_arguments": ("nation", "SELECT n_nationkey, mask(n_name, lowerChar => 'q') AS m FROM nation", "SELECT n_nationkey, regexp_replace(regexp_replace(regexp_replace(n_name, '[A-Z]', 'X', 'g'), '[a-z]', 'q', 'g'), '[0-9]', 'n', 'g') AS m FROM nation"),
    "sql_literals": ("region", "SELECT 1Y AS y, 2S AS s, 3L AS l, 1.5D AS d, 2.5F AS f, 1.25BD AS bd, X'4142' AS x, DATE '2024-02-29' AS dt, TIMESTAMP_NTZ '2024-02-29 01:02:03.5' AS ts, 'a\\tb' AS e, r'a\\tb' AS r FROM region", "SELECT 1::TINYINT AS y, 2::SMALLINT AS s, 3::BIGINT AS l, 1.5::DOUBLE AS d, 2.5::FLOAT AS f, 1.25 AS bd, 'AB'::BLOB AS x, DATE '2024-02-29' AS dt, TIMESTAMP '2024-02-29 01:02:03.5' AS ts, 'a' || chr(9) || 'b' AS e, 'a\\tb' AS r FROM region"),
    "sql_range": ("region", "SELECT id FROM range(2, 20, 3)", "SELECT range AS id FROM range(2, 20, 3)"),
    "sql_tuple_struct": ("nation", "SELECT n_nationkey, STRUCT(n_name AS a, 1 AS b).a AS a, (n_name, 2).col2 AS b FROM nation", "SELECT n_nationkey, n_name AS a, 2 AS b FROM nation"),
    "sql_in_struct": ("nation", "SELECT n_nationkey FROM nation WHERE (n_nationkey, n_regionkey) IN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 1)"),
    "sql_not_greater": ("nation", "SELECT n_nationkey FROM nation WHERE n_nationkey !> 5 AND n_nationkey !< 2", "SELECT n_nationkey FROM nation WHERE n_nationkey <= 5 AND n_nationkey >= 2"),
    "sql_with_rollup": ("nation", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey WITH ROLLUP", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey)"),
    "sql_with_cube": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority WITH CUBE", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
}
_SQL_QUERIES, _SQL_ORACLES = paired(_SQL)
QUERIES = _SQL_QUERIES | {
    f.__name__: f
    for f in (star_options, struct_update, alias_metadata, parameters_by_place, create_table_as, insert_overwrite, insert_columns, insert_directory, write_append, write_overwrite_partitions, write_overwrite_where, write_buckets, catalog_commands, temp_views)
}
_COMMANDS = {"databases": 1, "tables": 1, "columns": 2, "after alter": 3, "views": 1, "like": 3, "properties": 1, "cached": 1, "create": 1, "explain": 1, "left": 1}
ORACLES = _SQL_ORACLES | {
    "star_options": "SELECT n_nationkey AS key, upper(n_name) AS n_name FROM nation", "struct_update": "SELECT n_nationkey AS a, 1 AS c FROM nation", "alias_metadata": "SELECT r_name AS name, 'none' AS unit FROM region",
    "parameters_by_place": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 450000", "create_table_as": "SELECT n_nationkey, n_name FROM nation", "insert_overwrite": "SELECT r_regionkey AS k, r_name AS s FROM region",
    "insert_columns": "SELECT r_regionkey AS k, r_name AS s FROM region", "insert_directory": "SELECT * FROM region", "write_append": "SELECT * FROM region UNION ALL SELECT * FROM region",
    "write_overwrite_partitions": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new' ELSE n_name END AS n_name, n_regionkey FROM nation", "write_overwrite_where": "SELECT * FROM nation WHERE n_regionkey >= 3 UNION ALL SELECT * FROM nation WHERE n_nationkey = 0",
    "write_buckets": "SELECT o_orderkey, o_custkey FROM orders", "catalog_commands": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _COMMANDS.items()) + ") t(what, n)", "temp_views": "SELECT r_name, r_regionkey FROM region",
}
