"""Missing-value and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import statistics as ops
from millrace.sources.tables import load


def _gappy(spark, folder):
    return load(spark, folder, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') AS s", "CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS p", "CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS c")


_GAPPY = "(SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS p, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS c FROM orders)"

QUERIES = {
    "na_fill_number": lambda s, f: ops.fill_null(_gappy(s, f), 0),
    "na_fill_text": lambda s, f: ops.fill_null(_gappy(s, f), "none"),
    "na_fill_columns": lambda s, f: _gappy(s, f).na.fill({"s": "x", "p": -1.0}),
    "na_drop_any": lambda s, f: ops.drop_missing(_gappy(s, f)),
    "na_drop_threshold": lambda s, f: ops.drop_missing(_gappy(s, f), 2, ["s", "p", "c"]),
    "na_replace": lambda s, f: ops.replace_values(load(s, f, "orders").select("o_orderkey", "o_orderstatus"), {"F": "done", "O": "open"}, ["o_orderstatus"]),
    "stat_cov": lambda s, f: load(s, f, "lineitem").agg(F.round(F.covar_samp("l_quantity", "l_extendedprice") / 1e3, 4).alias("cov")),
    "stat_corr": lambda s, f: load(s, f, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr")),
    "stat_crosstab": lambda s, f: ops.crosstab(load(s, f, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]),
    "stat_summary": lambda s, f: ops.summary(load(s, f, "part").select("p_size"), ["p_size"], exact=True).where("summary IN ('count', 'min', '50%', 'max')"),
    "stat_describe": lambda s, f: load(s, f, "part").describe("p_size").where("summary IN ('count', 'min', 'max')"),
    "stat_sample_by": lambda s, f: ops.sample_by(load(s, f, "orders"), "o_orderstatus", {"F": 1.0, "O": 0.0}, 3).groupBy("o_orderstatus").agg(F.count("*").alias("n")),
    "stat_freq_items": lambda s, f: ops.frequent_items(load(s, f, "orders"), "o_orderstatus", 0.2),
    "stat_approx_quantile": lambda s, f: load(s, f, "lineitem").agg((F.abs(F.percentile_approx("l_quantity", 0.5, 10000) - 25.5) < 2).alias("near")),
    "schema_pivot": lambda s, f: ops.schema_pivot(load(s, f, "nation"), "n_nationkey"),
}
ORACLES = {
    "na_fill_number": f"SELECT o_orderkey, s, coalesce(p, 0) AS p, coalesce(c, 0) AS c FROM {_GAPPY}",
    "na_fill_text": f"SELECT o_orderkey, coalesce(s, 'none') AS s, p, c FROM {_GAPPY}",
    "na_fill_columns": f"SELECT o_orderkey, coalesce(s, 'x') AS s, coalesce(p, -1) AS p, c FROM {_GAPPY}",
    "na_drop_any": f"SELECT * FROM {_GAPPY} WHERE s IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL",
    "na_drop_threshold": f"SELECT * FROM {_GAPPY} WHERE (s IS NOT NULL)::INT + (p IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2",
    "na_replace": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "stat_cov": "SELECT round(covar_samp(l_quantity, l_extendedprice) / 1e3, 4) AS cov FROM lineitem",
    "stat_corr": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem",
    "stat_crosstab": "SELECT o_orderpriority AS o_orderpriority_o_orderstatus, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "stat_summary": "SELECT 'count' AS summary, count(p_size)::VARCHAR AS p_size FROM part UNION ALL SELECT 'min', min(p_size)::VARCHAR FROM part UNION ALL SELECT '50%', printf('%.1f', median(p_size)) FROM part UNION ALL SELECT 'max', max(p_size)::VARCHAR FROM part",
    "stat_describe": "SELECT 'count' AS summary, count(p_size)::VARCHAR AS p_size FROM part UNION ALL SELECT 'min', min(p_size)::VARCHAR FROM part UNION ALL SELECT 'max', max(p_size)::VARCHAR FROM part",
    "stat_sample_by": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "stat_freq_items": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 0.2 * (SELECT count(*) FROM orders)",
    "stat_approx_quantile": "SELECT true AS near",
    "schema_pivot": "SELECT n_nationkey, 'n_name' AS column_name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation",
}
