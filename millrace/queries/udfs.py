"""Every form of user function, with bodies that SQL can state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.tables import load, register

twice = F.udf(lambda x: None if x is None else x * 2, T.LongType())
twice_arrow = F.udf(lambda x: None if x is None else x * 2, T.LongType(), useArrow=True)


def _with_tax(price: pd.Series, tax: pd.Series) -> pd.Series:
    return price * (1 + tax)


def _plus_one(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part + 1


def _spread(values: pd.Series) -> float:
    return float(values.max() - values.min())


with_tax = F.pandas_udf(_with_tax, T.DoubleType())
plus_one = F.pandas_udf(_plus_one, T.LongType())
spread = F.pandas_udf(_spread, T.DoubleType())


@F.udtf(returnType=T.StructType().add("word", T.StringType()).add("place", T.IntegerType()))
class Words:
    """The words of a text with their places."""

    def eval(self, text: str):
        for i, word in enumerate(text.split("-")):
            yield word, i


@F.udtf(returnType=T.StructType().add("k", T.LongType()).add("n", T.LongType()))
class CountRows:
    """A table function over a table argument."""

    def __init__(self):
        self.n, self.k = 0, None

    def eval(self, row):
        self.k = row["k"]
        self.n += 1

    def terminate(self):
        if self.n:
            yield self.k, self.n


#: Rows that one group of a grouped map holds at most, about.
GROUP_ROWS = 50_000


def _grouped(spark, folder):
    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["o_totalprice", "o_orderkey"]).drop_duplicates("o_custkey", keep="last")[["o_custkey", "o_orderkey"]]

    df = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    groups = max(1, -(-df.count() // GROUP_ROWS))
    return df.groupBy(F.pmod(F.xxhash64("o_custkey"), F.lit(groups))).applyInPandas(best, "o_custkey bigint, o_orderkey bigint")


def _grouped_arrow(spark, folder):
    def count(table: pa.Table) -> pa.Table:
        return pa.table({"o_orderpriority": table["o_orderpriority"].slice(0, 1), "n": pa.array([table.num_rows], pa.int64())})

    return load(spark, folder, "part").selectExpr("p_brand AS o_orderpriority", "p_size").groupBy("o_orderpriority").applyInArrow(count, "o_orderpriority string, n bigint")


def _cogrouped(spark, folder):
    def totals(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        key = (left if len(left) else right)["k"].iloc[0]
        return pd.DataFrame({"k": [key], "customers": [len(left)], "suppliers": [len(right)]})

    c, s = load(spark, folder, "customer").selectExpr("c_nationkey AS k", "c_custkey"), load(spark, folder, "supplier").selectExpr("s_nationkey AS k", "s_suppkey")
    return c.groupBy("k").cogroup(s.groupBy("k")).applyInPandas(totals, "k int, customers bigint, suppliers bigint")


def _map_pandas(spark, folder):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[part["o_totalprice"] > 400000][["o_orderkey"]]

    return load(spark, folder, "orders").select("o_orderkey", "o_totalprice").mapInPandas(run, "o_orderkey bigint")


def _map_arrow(spark, folder):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pc.less(part["o_totalprice"], 20000.0)).select(["o_orderkey"])

    return load(spark, folder, "orders").select("o_orderkey", "o_totalprice").mapInArrow(run, "o_orderkey bigint")


def _registered(spark, folder):
    spark.udf.register("twice", twice)
    spark.udf.register("with_tax", with_tax)
    return register(spark, folder, "lineitem").sql("SELECT l_orderkey, twice(l_partkey) AS t, round(with_tax(l_extendedprice, l_tax), 4) AS p FROM lineitem")


def _udtf(spark, folder):
    spark.udtf.register("words", Words)
    return register(spark, folder, "orders").sql("SELECT o_orderkey, w.word, w.place FROM orders, LATERAL words(o_orderpriority) w")


def _udtf_table(spark, folder):
    spark.udtf.register("count_rows", CountRows)
    return register(spark, folder, "supplier").sql("SELECT k, n FROM count_rows(TABLE(SELECT cast(s_nationkey AS bigint) AS k FROM supplier) PARTITION BY k)")


QUERIES = {
    "udf_plain": lambda s, f: load(s, f, "orders").select("o_orderkey", twice("o_custkey").alias("t")),
    "udf_arrow": lambda s, f: load(s, f, "orders").select("o_orderkey", twice_arrow("o_custkey").alias("t")),
    "udf_pandas": lambda s, f: load(s, f, "lineitem").select("l_orderkey", F.round(with_tax("l_extendedprice", "l_tax"), 4).alias("p")),
    "udf_pandas_iterator": lambda s, f: load(s, f, "orders").select("o_orderkey", plus_one("o_custkey").alias("p")),
    "udf_aggregate": lambda s, f: load(s, f, "lineitem").groupBy("l_returnflag").agg(spread("l_quantity").alias("spread")),
    "udf_aggregate_window": lambda s, f: load(s, f, "supplier").select("s_suppkey", spread("s_acctbal").over(Window.partitionBy("s_nationkey")).alias("spread")),
    "udf_grouped_map": _grouped, "udf_grouped_arrow": _grouped_arrow, "udf_cogrouped": _cogrouped, "udf_map_pandas": _map_pandas, "udf_map_arrow": _map_arrow, "udf_registered": _registered, "udtf": _udtf, "udtf_table": _udtf_table,
}
ORACLES = {
    "udf_plain": "SELECT o_orderkey, o_custkey * 2 AS t FROM orders", "udf_arrow": "SELECT o_orderkey, o_custkey * 2 AS t FROM orders",
    "udf_pandas": "SELECT l_orderkey, round(l_extendedprice * (1 + l_tax), 4) AS p FROM lineitem", "udf_pandas_iterator": "SELECT o_orderkey, o_custkey + 1 AS p FROM orders",
    "udf_aggregate": "SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1",
    "udf_aggregate_window": "SELECT s_suppkey, max(s_acctbal) OVER (PARTITION BY s_nationkey) - min(s_acctbal) OVER (PARTITION BY s_nationkey) AS spread FROM supplier",
    "udf_grouped_map": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1",
    "udf_grouped_arrow": "SELECT p_brand AS o_orderpriority, count(*) AS n FROM part GROUP BY 1",
    "udf_cogrouped": "SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k",
    "udf_map_pandas": "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000", "udf_map_arrow": "SELECT o_orderkey FROM orders WHERE o_totalprice < 20000",
    "udf_registered": "SELECT l_orderkey, l_partkey * 2 AS t, round(l_extendedprice * (1 + l_tax), 4) AS p FROM lineitem",
    "udtf": "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS word, (unnest(range(len(string_split(o_orderpriority, '-')))))::INT AS place FROM orders",
    "udtf_table": "SELECT s_nationkey::BIGINT AS k, count(*) AS n FROM supplier GROUP BY 1",
}
