"""Aggregate functions, per group."""

from __future__ import annotations

from millrace.queries.sqltext import paired

_L = "FROM lineitem GROUP BY l_returnflag"
_SQL = {
    "agg_boolean": ("lineitem", f"SELECT l_returnflag, any(l_quantity > 49) AS a, some(l_quantity > 49) AS s, bool_or(l_quantity > 50) AS o, every(l_quantity > 0) AS e, bool_and(l_quantity > 1) AS b {_L}", f"SELECT l_returnflag, bool_or(l_quantity > 49) AS a, bool_or(l_quantity > 49) AS s, bool_or(l_quantity > 50) AS o, bool_and(l_quantity > 0) AS e, bool_and(l_quantity > 1) AS b {_L}"),
    "agg_basic": ("lineitem", f"SELECT l_returnflag, count(*) AS n, count(l_tax) AS c, count_if(l_tax > 0.04) AS ci, round(sum(l_tax), 4) AS s, round(avg(l_tax), 6) AS a, round(mean(l_tax), 6) AS m, min(l_tax) AS lo, max(l_tax) AS hi {_L}", f"SELECT l_returnflag, count(*) AS n, count(l_tax) AS c, count_if(l_tax > 0.04)::BIGINT AS ci, round(sum(l_tax), 4) AS s, round(avg(l_tax), 6) AS a, round(avg(l_tax), 6) AS m, min(l_tax) AS lo, max(l_tax) AS hi {_L}"),
    "agg_bits": ("lineitem", f"SELECT l_returnflag, bit_and(l_partkey) AS a, bit_or(l_partkey) AS o, bit_xor(l_partkey) AS x {_L}"),
    "agg_moments": ("lineitem", f"SELECT l_returnflag, round(std(l_quantity), 6) AS sd, round(stddev(l_quantity), 6) AS s1, round(stddev_samp(l_quantity), 6) AS s2, round(stddev_pop(l_quantity), 6) AS sp, round(variance(l_quantity), 5) AS v, round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp, round(kurtosis(l_quantity), 5) AS k, round(skewness(l_tax), 5) AS sk {_L}",
        f"SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev(l_quantity), 6) AS s1, round(stddev_samp(l_quantity), 6) AS s2, round(stddev_pop(l_quantity), 6) AS sp, round(variance(l_quantity), 5) AS v, round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp, round(kurtosis_pop(l_quantity), 5) AS k, round(skewness(l_tax) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 5) AS sk {_L}"),
    "agg_pairs": ("lineitem", f"SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs {_L}"),
    "agg_regr": ("lineitem", f"SELECT l_returnflag, round(regr_avgx(l_extendedprice, l_quantity), 5) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay, regr_count(l_extendedprice, l_quantity) AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_sxx(l_extendedprice, l_quantity) / 1e6, 4) AS xx, round(regr_sxy(l_extendedprice, l_quantity) / 1e9, 4) AS xy, round(regr_syy(l_extendedprice, l_quantity) / 1e12, 4) AS yy {_L}",
        f"SELECT l_returnflag, round(regr_avgx(l_extendedprice, l_quantity), 5) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_intercept(l_extendedprice, l_quantity), 3) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_sxx(l_extendedprice, l_quantity) / 1e6, 4) AS xx, round(regr_sxy(l_extendedprice, l_quantity) / 1e9, 4) AS xy, round(regr_syy(l_extendedprice, l_quantity) / 1e12, 4) AS yy {_L}"),
    "agg_collect": ("supplier", "SELECT s_nationkey, sort_array(array_agg(s_suppkey)) AS a, sort_array(collect_list(s_suppkey)) AS l, sort_array(collect_set(s_suppkey % 3)) AS s, listagg(s_name, ',') WITHIN GROUP (ORDER BY s_name) AS t, string_agg(s_name, '|') WITHIN GROUP (ORDER BY s_name DESC) AS u FROM supplier GROUP BY s_nationkey",
        "SELECT s_nationkey, list_sort(list(s_suppkey)) AS a, list_sort(list(s_suppkey)) AS l, list_sort(list(DISTINCT s_suppkey % 3)) AS s, string_agg(s_name, ',' ORDER BY s_name) AS t, string_agg(s_name, '|' ORDER BY s_name DESC) AS u FROM supplier GROUP BY s_nationkey"),
    "agg_by": ("orders", "SELECT o_orderstatus, max_by(o_orderkey, o_totalprice) AS hi, min_by(o_orderkey, o_totalprice) AS lo FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS hi, arg_min(o_orderkey, o_totalprice) AS lo FROM orders GROUP BY o_orderstatus"),
    "agg_percentile": ("lineitem", f"SELECT l_returnflag, round(median(l_extendedprice), 4) AS m, round(percentile(l_extendedprice, 0.25), 4) AS p, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS c {_L}", f"SELECT l_returnflag, round(median(l_extendedprice), 4) AS m, round(quantile_cont(l_extendedprice, 0.25), 4) AS p, round(quantile_cont(l_extendedprice, 0.9), 4) AS c {_L}"),
    "agg_mode": ("events", "SELECT user_id % 5 AS g, mode(cast(floor(value) AS int), true) AS m FROM events GROUP BY user_id % 5",
        "SELECT g, min(v) AS m FROM (SELECT user_id % 5 AS g, floor(value)::INT AS v, count(*) AS n, max(count(*)) OVER (PARTITION BY user_id % 5) AS top FROM events GROUP BY 1, 2) WHERE n = top GROUP BY g"),
    "agg_approx_count": ("lineitem", f"SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS near {_L}", f"SELECT l_returnflag, true AS near {_L}"),
    "agg_approx_percentile": ("lineitem", f"SELECT l_returnflag, abs(approx_percentile(l_quantity, 0.5) - 25.5) < 2 AS a, abs(percentile_approx(l_quantity, 0.5, 10000) - 25.5) < 2 AS b {_L}", f"SELECT l_returnflag, true AS a, true AS b {_L}"),
    "agg_any": ("nation", "SELECT n_regionkey, any_value(n_regionkey) AS a, first(n_regionkey) AS f, first_value(n_regionkey) AS fv, last(n_regionkey) AS l, last_value(n_regionkey) AS lv FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, n_regionkey AS a, n_regionkey AS f, n_regionkey AS fv, n_regionkey AS l, n_regionkey AS lv FROM nation GROUP BY n_regionkey"),
    "agg_try": ("orders", "SELECT o_orderstatus, try_sum(o_orderkey + 9223372036854760000) AS s, round(try_avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, NULL::BIGINT AS s, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderstatus"),
    "agg_bitmap": ("orders", "SELECT bitmap_bucket_number(o_custkey + 1) AS b, bitmap_count(bitmap_construct_agg(bitmap_bit_position(o_custkey + 1))) AS n FROM orders GROUP BY 1", "SELECT o_custkey // 32768 + 1 AS b, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1"),
    "agg_bitmap_or": ("orders", "SELECT bitmap_count(bitmap_or_agg(m)) AS n FROM (SELECT o_orderstatus, bitmap_construct_agg(bitmap_bit_position(o_custkey % 1000 + 1)) AS m FROM orders GROUP BY o_orderstatus)", "SELECT count(DISTINCT o_custkey % 1000) AS n FROM orders"),
    "agg_hll": ("orders", "SELECT abs(hll_sketch_estimate(hll_union_agg(h)) - (SELECT count(DISTINCT o_custkey) FROM orders)) <= 0.1 * (SELECT count(DISTINCT o_custkey) FROM orders) AS near FROM (SELECT o_orderstatus, hll_sketch_agg(o_custkey) AS h FROM orders GROUP BY o_orderstatus)", "SELECT true AS near"),
    "agg_hll_union": ("orders", "SELECT abs(hll_sketch_estimate(hll_union(hll_sketch_agg(o_custkey), hll_sketch_agg(o_custkey + 1))) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS near FROM orders", "SELECT true AS near"),
    "agg_count_min": ("orders", "SELECT o_orderstatus, length(count_min_sketch(o_custkey, 0.01D, 0.9D, 1)) > 0 AS made FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, true AS made FROM orders GROUP BY 1"),
    "agg_histogram": ("orders", "SELECT o_orderstatus, size(histogram_numeric(o_totalprice, 5)) AS bins FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, 5 AS bins FROM orders GROUP BY 1"),
    "agg_grouping": ("nation", "SELECT n_regionkey, cast(grouping(n_regionkey) AS int) AS g, cast(grouping_id(n_regionkey) AS int) AS gi, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey)"),
}
QUERIES, ORACLES = paired(_SQL)
