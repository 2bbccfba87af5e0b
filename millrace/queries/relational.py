"""Relational operators: scans, filters, joins, aggregation, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import relational as ops
from millrace.queries.sqltext import paired
from millrace.sources.tables import load, register


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of lineitem per return flag and line status."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        load(spark, folder, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
    )


def scan_filter_project(spark, folder):
    """Filter and projection that reach the scan."""
    return load(spark, folder, "orders").where("o_totalprice > 250000 AND o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"))


def with_columns(spark, folder):
    """withColumns, withColumnsRenamed, drop, in order."""
    df = load(spark, folder, "nation").withColumns({"k10": F.col("n_nationkey") * 10, "up": F.upper("n_name")})
    return df.withColumnsRenamed({"n_name": "name"}).drop("n_regionkey", "missing")


def to_df(spark, folder):
    """toDF renames by place."""
    return load(spark, folder, "region").toDF("key", "label")


def to_schema(spark, folder):
    """to(schema) reorders by name and casts."""
    return load(spark, folder, "region").to(load(spark, folder, "region").selectExpr("r_name", "cast(r_regionkey AS bigint) AS r_regionkey").schema)


def col_regex(spark, folder):
    """Columns by pattern."""
    df = load(spark, folder, "supplier")
    return df.select(df.colRegex("`s_.*key`"))


def metadata_column(spark, folder):
    """The file's name from the hidden metadata column."""
    return load(spark, folder, "region").selectExpr("r_regionkey", "_metadata.file_name LIKE '%.parquet' AS from_parquet")


def _join(how):
    def run(spark, folder):
        c = load(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal").where("c_acctbal > 0")
        s = load(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").where("s_acctbal > 5000")
        return c.join(s, (c.c_nationkey == s.s_nationkey) & (c.c_acctbal > s.s_acctbal), how)

    run.__doc__ = f"{how} join on a key and a comparison."
    return run


_JOIN_SQL = """SELECT {cols} FROM (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0) c {how} JOIN (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 5000) s
    ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal"""
_ALL = "c_custkey, c_nationkey, c_acctbal, s_suppkey, s_nationkey, s_acctbal"


def join_cross(spark, folder):
    """Cross product of two dimension tables of fixed size."""
    return load(spark, folder, "region").crossJoin(load(spark, folder, "nation").select("n_nationkey"))


def _f_orders(spark, folder):
    return load(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))


def join_semi(spark, folder):
    """Customers with an F order."""
    return load(spark, folder, "customer").select("c_custkey", "c_name").join(_f_orders(spark, folder), "c_custkey", "left_semi")


def join_anti(spark, folder):
    """Customers without an F order."""
    return load(spark, folder, "customer").select("c_custkey", "c_name").join(_f_orders(spark, folder), "c_custkey", "left_anti")


def join_right_semi(spark, folder):
    """Right semi: sides swapped."""
    return ops.right_semi(_f_orders(spark, folder), load(spark, folder, "customer").select("c_custkey", "c_name"), ["c_custkey"])


def join_right_anti(spark, folder):
    """Right anti: sides swapped."""
    return ops.right_anti(_f_orders(spark, folder), load(spark, folder, "customer").select("c_custkey", "c_name"), ["c_custkey"])


def join_with_structs(spark, folder):
    """joinWith: each side a struct."""
    n, r = load(spark, folder, "nation"), load(spark, folder, "region")
    return ops.join_with(n, r, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("left.n_name", "right.r_name")


def join_salted(spark, folder):
    """A join on a skewed key, salted."""
    e = load(spark, folder, "events").select("event_id", "event_type")
    t = e.groupBy("event_type").agg(F.count("*").alias("of_type"))
    return ops.salted_join(e, t, ["event_type"], 8)


def join_interval(spark, folder):
    """Points in intervals with fractional ends, short and long ones, by an equi-join on buckets."""
    o = load(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    bands = load(spark, folder, "nation").selectExpr("n_nationkey", "n_nationkey * 15000.25D AS low", "CASE WHEN n_nationkey = 24 THEN 1.0E9D ELSE n_nationkey * 15000.25D + 20000.5D END AS high")
    return ops.interval_join(o, bands, "price", "low", "high", 20000).select("o_orderkey", "n_nationkey")


def join_asof(spark, folder):
    """Latest earlier purchase of each user's view."""
    e = load(spark, folder, "events")
    left = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").selectExpr("user_id", "ts AS at", "event_id AS bought")
    return ops.asof_join(left, right, ["user_id"], "ts", "at", ["bought"]).select("event_id", "bought")


def union_by_name(spark, folder):
    """Union by name with missing columns."""
    a = load(spark, folder, "customer").selectExpr("c_nationkey AS k", "c_name AS n")
    b = load(spark, folder, "supplier").selectExpr("s_name AS n", "s_nationkey AS k", "s_acctbal AS bal")
    return a.unionByName(b, allowMissingColumns=True)


def _nations(spark, folder):
    return load(spark, folder, "customer").selectExpr("c_nationkey AS k"), load(spark, folder, "supplier").selectExpr("s_nationkey AS k")


def intersect_all(spark, folder):
    """INTERSECT ALL."""
    a, b = _nations(spark, folder)
    return a.intersectAll(b)


def except_all(spark, folder):
    """EXCEPT ALL."""
    a, b = _nations(spark, folder)
    return a.exceptAll(b)


def dedup(spark, folder):
    """First row per key by an order."""
    li = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    return ops.distinct_on(li, ["l_orderkey"], [F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")])


def tail_rows(spark, folder):
    """The last rows by an order."""
    return ops.tail(load(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 10, [F.col("o_totalprice").asc(), F.col("o_orderkey").asc()])


def sort_within_partitions(spark, folder):
    """SORT BY: rows unchanged."""
    return load(spark, folder, "orders").select("o_orderkey", "o_custkey").sortWithinPartitions("o_custkey")


def cluster_by(spark, folder):
    """CLUSTER BY: rows unchanged."""
    return ops.cluster_by(load(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


def repartition_rows(spark, folder):
    """repartition, repartitionByRange and coalesce keep all rows."""
    df = load(spark, folder, "orders").select("o_orderkey")
    return df.repartition(8).repartitionByRange(4, "o_orderkey").coalesce(2)


def range_rows(spark, folder):
    """range(start, end, step)."""
    return ops.range_frame(spark, 5, 100, 3)


def sample_bounds(spark, folder):
    """A sample's share lies near its fraction; with replacement too."""
    df = load(spark, folder, "lineitem").select("l_orderkey")
    n = df.count()
    a, b = df.sample(0.3, seed=7).agg(F.count("*").alias("n")), df.sample(True, 0.5, seed=7).agg(F.count("*").alias("n"))
    return a.selectExpr("'plain' AS kind", f"n BETWEEN {int(n * 0.2)} AND {int(n * 0.4)} AS near").union(b.selectExpr("'repeat' AS kind", f"n BETWEEN {int(n * 0.4)} AND {int(n * 0.6)} AS near"))


def parameters(spark, folder):
    """Named parameters."""
    return register(spark, folder, "orders").sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = :s AND o_totalprice > :p", args={"s": "F", "p": 400000.0})


def collect_metrics(spark, folder):
    """observe leaves the rows as they are."""
    return load(spark, folder, "nation").observe("seen", F.count("*").alias("n")).select("n_nationkey")


def hint_broadcast(spark, folder):
    """A join hint on a dimension table of fixed size."""
    return load(spark, folder, "nation").join(load(spark, folder, "region").hint("broadcast"), F.expr("n_regionkey = r_regionkey")).select("n_name", "r_name")


def local_relation(spark, folder):
    """Rows given by the driver, cast to a schema."""
    return spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "k BIGINT, s STRING, v DOUBLE")


def pivot(spark, folder):
    """Orders by status and priority."""
    totals = load(spark, folder, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return totals.na.fill(0)


def unpivot(spark, folder):
    """Columns of part to rows."""
    return load(spark, folder, "part").selectExpr("p_partkey", "p_brand", "p_type").unpivot("p_partkey", ["p_brand", "p_type"], "what", "value")


def lateral_join(spark, folder):
    """A correlated lateral subquery."""
    return register(spark, folder, "nation", "supplier").sql("SELECT n_name, t.top FROM nation, LATERAL (SELECT max(s_acctbal) AS top FROM supplier WHERE s_nationkey = n_nationkey) t")


_SQL = {
    "agg_group": ("lineitem", "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10"),
    "agg_global": ("lineitem", "SELECT count(*) AS n, round(avg(l_tax), 6) AS a FROM lineitem HAVING count(*) > 0"),
    "agg_filter_clause": ("orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 250000) AS big FROM orders GROUP BY o_orderpriority"),
    "agg_distinct": ("lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag"),
    "group_ordinal_alias": ("orders", "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY y, 2", "SELECT year(o_orderdate)::INT AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2"),
    "rollup": ("customer nation region", "SELECT r_name, n_name, grouping(n_name) AS g, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)", "SELECT r_name, n_name, grouping(n_name)::TINYINT AS g, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"),
    "cube": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "grouping_sets": ("orders", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "join_theta": ("nation region", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey > r_regionkey * 5"),
    "join_using": ("nation supplier", "SELECT s.s_suppkey, nationkey FROM (SELECT n_nationkey AS nationkey, n_name FROM nation) n JOIN (SELECT s_nationkey AS nationkey, s_suppkey FROM supplier) s USING (nationkey)"),
    "join_using_full": ("nation supplier", "SELECT nationkey, s_suppkey, n_name FROM (SELECT n_nationkey AS nationkey, n_name FROM nation WHERE n_nationkey > 3) n FULL JOIN (SELECT s_nationkey AS nationkey, s_suppkey FROM supplier) s USING (nationkey)"),
    "join_natural": ("nation supplier", "SELECT nationkey, s_suppkey, n_name FROM (SELECT n_nationkey AS nationkey, n_name FROM nation) n NATURAL JOIN (SELECT s_nationkey AS nationkey, s_suppkey FROM supplier) s"),
    "join_null_safe": ("nation region", "SELECT n_name, r_name FROM nation JOIN region ON nullif(n_regionkey, 0) <=> nullif(r_regionkey, 0)", "SELECT n_name, r_name FROM nation JOIN region ON nullif(n_regionkey, 0) IS NOT DISTINCT FROM nullif(r_regionkey, 0)"),
    "union_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_distinct": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "except": ("customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 5"),
    "set_precedence": ("nation region", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation WHERE n_regionkey > 2"),
    "distinct": ("lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "sort_nulls": ("orders", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC NULLS LAST, o_orderkey"),
    "limit_offset": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "topk": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "cte": ("nation region", "WITH r(k, name) AS (SELECT r_regionkey, r_name FROM region), n AS (SELECT n_name, name FROM nation JOIN r ON n_regionkey = k) SELECT name, count(*) AS n FROM n GROUP BY name"),
    "recursive_cte": ("region", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, r_name FROM t JOIN region ON n % 5 = r_regionkey"),
    "subquery_scalar": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)"),
    "subquery_in": ("orders customer", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"),
    "subquery_not_in": ("orders customer", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "subquery_exists": ("orders customer", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')"),
    "subquery_correlated": ("orders customer", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c"),
    "values_rows": ("nation", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS t(k, s)"),
    "one_row": ("nation", "SELECT 1 AS one, 'x' AS x"),
    "star_except": ("nation", "SELECT * EXCEPT (n_regionkey) FROM nation", "SELECT * EXCLUDE (n_regionkey) FROM nation"),
    "qualified_star": ("nation region", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey"),
    "alias_columns": ("region", "SELECT a, b FROM (SELECT r_regionkey, r_name FROM region) t(a, b)"),
    "lateral_view": ("orders", "SELECT o_orderkey, w FROM orders LATERAL VIEW explode(split(o_orderpriority, '-')) t AS w", "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w FROM orders"),
    "lateral_view_outer": ("orders", "SELECT o_orderkey, w FROM orders LATERAL VIEW OUTER explode(filter(split(o_orderpriority, '-'), x -> x > '3')) t AS w", "SELECT o_orderkey, w FROM orders LEFT JOIN LATERAL (SELECT unnest(list_filter(string_split(o_orderpriority, '-'), lambda x: x > '3')) AS w) ON true"),
    "explode": ("embeddings", "SELECT vec_id, explode(transform(embedding, x -> round(cast(x AS double), 4))) AS v FROM embeddings", "SELECT vec_id, unnest(list_transform(embedding, lambda x: round(x::DOUBLE, 4))) AS v FROM embeddings"),
    "explode_outer": ("embeddings", "SELECT vec_id, explode_outer(filter(array(label), x -> x > 4)) AS v FROM embeddings", "SELECT vec_id, CASE WHEN label > 4 THEN label END AS v FROM embeddings"),
    "explode_map": ("embeddings", "SELECT vec_id, explode(map('a', label)) AS (k, v) FROM embeddings", "SELECT vec_id, 'a' AS k, label AS v FROM embeddings"),
    "posexplode": ("embeddings", "SELECT vec_id, posexplode(array(label, label + 1)) AS (p, v) FROM embeddings", "SELECT vec_id, 0 AS p, label AS v FROM embeddings UNION ALL SELECT vec_id, 1, label + 1 FROM embeddings"),
    "posexplode_outer": ("embeddings", "SELECT vec_id, posexplode_outer(filter(array(label), x -> x > 4)) AS (p, v) FROM embeddings", "SELECT vec_id, CASE WHEN label > 4 THEN 0 END AS p, CASE WHEN label > 4 THEN label END AS v FROM embeddings"),
    "inline": ("embeddings", "SELECT vec_id, inline(array(struct(label AS a, 1 AS b), struct(2 AS a, 3 AS b))) FROM embeddings", "SELECT vec_id, label AS a, 1 AS b FROM embeddings UNION ALL SELECT vec_id, 2, 3 FROM embeddings"),
    "inline_outer": ("embeddings", "SELECT vec_id, inline_outer(CASE WHEN label > 4 THEN array(struct(label AS a)) END) FROM embeddings", "SELECT vec_id, CASE WHEN label > 4 THEN label END AS a FROM embeddings"),
    "stack": ("nation", "SELECT n_nationkey, stack(2, 'name', n_name, 'region', cast(n_regionkey AS string)) AS (what, v) FROM nation", "SELECT n_nationkey, 'name' AS what, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation"),
    "json_tuple": ("events", "SELECT event_id, json_tuple(props, 'k', 'none') AS (k, none) FROM events", "SELECT event_id, props->>'$.k' AS k, props->>'$.none' AS none FROM events"),
    "pivot_sql": ("orders", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (round(max(o_totalprice), 2) FOR o_orderstatus IN ('F' AS f, 'O' AS o))", "SELECT o_orderpriority, round(max(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS f, round(max(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o FROM orders GROUP BY 1"),
    "unpivot_nulls": ("nation", "SELECT * FROM (SELECT n_nationkey, n_name AS a, nullif(n_name, n_name) AS b FROM nation) UNPIVOT INCLUDE NULLS (v FOR what IN (a, b))", "SELECT n_nationkey, 'a' AS what, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'b', NULL FROM nation"),
    "struct_fields": ("nation", "SELECT n_nationkey, s.x, s.y.z FROM (SELECT n_nationkey, struct(n_name AS x, struct(n_regionkey AS z) AS y) AS s FROM nation)", "SELECT n_nationkey, n_name AS x, n_regionkey AS z FROM nation"),
    "extract_items": ("nation", "SELECT n_nationkey, array(1, n_regionkey)[1] AS a, map('k', n_name)['k'] AS m FROM nation", "SELECT n_nationkey, n_regionkey AS a, n_name AS m FROM nation"),
    "intervals": ("orders", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS m, o_orderdate - INTERVAL '2 3' DAY TO HOUR AS d FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 51 HOUR AS d FROM orders"),
    "tablesample_rows": ("nation", "SELECT count(*) AS n FROM nation TABLESAMPLE (100 PERCENT)", "SELECT count(*) AS n FROM nation"),
    "distribute_by": ("orders", "SELECT o_orderkey FROM orders DISTRIBUTE BY o_custkey SORT BY o_orderkey", "SELECT o_orderkey FROM orders"),
}
_SQL_QUERIES, _SQL_ORACLES = paired(_SQL)

QUERIES = _SQL_QUERIES | {
    "pricing_summary": pricing_summary, "scan_filter_project": scan_filter_project, "with_columns": with_columns, "to_df": to_df, "to_schema": to_schema, "col_regex": col_regex, "metadata_column": metadata_column,
    "join_inner": _join("inner"), "join_left": _join("left"), "join_right": _join("right"), "join_full": _join("full"), "join_cross": join_cross, "join_semi": join_semi, "join_anti": join_anti, "join_right_semi": join_right_semi, "join_right_anti": join_right_anti,
    "join_with_structs": join_with_structs, "join_salted": join_salted, "join_interval": join_interval, "join_asof": join_asof, "union_by_name": union_by_name, "intersect_all": intersect_all, "except_all": except_all, "dedup": dedup, "tail_rows": tail_rows,
    "sort_within_partitions": sort_within_partitions, "cluster_by": cluster_by, "repartition_rows": repartition_rows, "range_rows": range_rows, "sample_bounds": sample_bounds, "parameters": parameters, "collect_metrics": collect_metrics, "hint_broadcast": hint_broadcast, "local_relation": local_relation, "pivot": pivot, "unpivot": unpivot, "lateral_join": lateral_join,
}
ORACLES = _SQL_ORACLES | {
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""",
    "scan_filter_project": "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'",
    "with_columns": "SELECT n_nationkey, n_name AS name, n_nationkey * 10 AS k10, upper(n_name) AS up FROM nation",
    "to_df": "SELECT r_regionkey AS key, r_name AS label FROM region", "to_schema": "SELECT r_name, r_regionkey::BIGINT AS r_regionkey FROM region",
    "col_regex": "SELECT s_suppkey, s_nationkey FROM supplier", "metadata_column": "SELECT r_regionkey, true AS from_parquet FROM region",
    "join_inner": _JOIN_SQL.format(cols=_ALL, how="INNER"), "join_left": _JOIN_SQL.format(cols=_ALL, how="LEFT"), "join_right": _JOIN_SQL.format(cols=_ALL, how="RIGHT"), "join_full": _JOIN_SQL.format(cols=_ALL, how="FULL"),
    "join_cross": "SELECT r_regionkey, r_name, n_nationkey FROM region CROSS JOIN nation",
    "join_semi": "SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey",
    "join_anti": "SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey",
    "join_right_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "join_right_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "join_with_structs": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_salted": "SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS of_type FROM events",
    "join_interval": "SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON o_totalprice >= n_nationkey * 15000.25::DOUBLE AND o_totalprice < CASE WHEN n_nationkey = 24 THEN 1e9::DOUBLE ELSE n_nationkey * 15000.25::DOUBLE + 20000.5::DOUBLE END",
    "join_asof": "SELECT l.event_id, r.event_id AS bought FROM (SELECT * FROM events WHERE event_type = 'view') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "union_by_name": "SELECT c_nationkey AS k, c_name AS n, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_nationkey, s_name, s_acctbal FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "dedup": "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey) = 1",
    "tail_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10",
    "sort_within_partitions": "SELECT o_orderkey, o_custkey FROM orders", "cluster_by": "SELECT o_orderkey, o_custkey FROM orders", "repartition_rows": "SELECT o_orderkey FROM orders", "range_rows": "SELECT range AS id FROM range(5, 100, 3)",
    "sample_bounds": "SELECT * FROM (VALUES ('plain', true), ('repeat', true)) t(kind, near)", "parameters": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000", "collect_metrics": "SELECT n_nationkey FROM nation",
    "hint_broadcast": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "local_relation": "SELECT * FROM (VALUES (1::BIGINT, 'a', 1.5::DOUBLE), (2, NULL, NULL)) t(k, s, v)",
    "pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "unpivot": "SELECT p_partkey, 'p_brand' AS what, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part",
    "lateral_join": "SELECT n_name, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS top FROM nation",
}
