"""Remote databases as sources of tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.accel.dsn import Dsn

STATS_SCHEMA = "table string, row_count bigint, total_bytes bigint"
#: Rows that one task of a snapshot reads.
ROWS_PER_TASK = 1_000_000

# How each kind of database tells its tables, rows and bytes.
STATS_SQL = {
    "postgresql": "SELECT schemaname || '.' || relname AS tab, n_tup_ins - n_tup_del AS row_count, pg_total_relation_size(relid) AS total_bytes FROM pg_stat_user_tables",
    "mysql": "SELECT concat(table_schema, '.', table_name) AS tab, coalesce(table_rows, 0) AS row_count, coalesce(data_length + index_length, 0) AS total_bytes FROM information_schema.tables WHERE table_type = 'BASE TABLE'",
    "derby": "SELECT s.SCHEMANAME || '.' || t.TABLENAME AS tab, CAST(0 AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS total_bytes FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID WHERE t.TABLETYPE = 'T'",
}


class JdbcSource:
    """Tables behind JDBC. Filters and columns are pushed to the database by Spark."""

    def __init__(self, spark: SparkSession, dsn: Dsn):
        self.spark, self.dsn = spark, dsn
        self.url, self.properties = dsn.jdbc()

    def _query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=f"({sql}) q", **self.properties).load()

    def tables(self) -> DataFrame:
        """table, row_count, total_bytes of every table; where the database keeps no counts, they are taken by a query each."""
        listed = self._query(STATS_SQL[self.dsn.kind]).toDF("table", "row_count", "total_bytes")
        if self.dsn.kind == "derby":
            rows = [(t, self._query(f"SELECT count(*) AS N FROM {t}").first()[0], 0) for (t, _, _) in listed.collect()]
            return self.spark.createDataFrame(rows, STATS_SCHEMA)
        return listed.selectExpr("`table`", "cast(row_count AS bigint) AS row_count", "cast(total_bytes AS bigint) AS total_bytes")

    def read(self, table: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The live table, read by one task; a projection and filters reach the database."""
        df = self.spark.read.jdbc(self.url, table, properties=self.properties)
        return df.select(*columns) if columns else df

    def read_parallel(self, table: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
        """The table in ranges of a whole-number primary key, as many as its size asks for; by one task without such a key."""
        keys = self.primary_key(table)
        kinds = dict(self.read(table).dtypes)
        if len(keys) != 1 or kinds.get(keys[0]) not in ("int", "bigint", "smallint"):
            return self.read(table)
        low, high, n = self._query(f"SELECT min({keys[0]}) AS a, max({keys[0]}) AS b, count(*) AS n FROM {table}").first()
        if not n:
            return self.read(table)
        parts = max(1, -(-n // rows_per_task))
        return self.spark.read.jdbc(self.url, table, column=keys[0], lowerBound=low, upperBound=high + 1, numPartitions=parts, properties=self.properties)

    def primary_key(self, table: str) -> list[str]:
        """Columns of the primary key, in order; from the driver's metadata."""
        jvm = self.spark._jvm
        held = jvm.java.util.Properties()
        for k, v in self.properties.items():
            held.setProperty(k, v)
        schema, _, name = table.rpartition(".")
        connection = jvm.java.sql.DriverManager.getConnection(self.url, held)
        try:
            found, rows = [], connection.getMetaData().getPrimaryKeys(None, schema or None, name)
            while rows.next():
                found.append((rows.getShort("KEY_SEQ"), rows.getString("COLUMN_NAME")))
            return [c for _, c in sorted(found)]
        finally:
            connection.close()


class FolderSource:
    """A folder of parquet tables taken as a database with the schema ``public``."""

    def __init__(self, spark: SparkSession, dsn: Dsn, keys: dict[str, list[str]] | None = None):
        self.spark, self.folder, self.keys = spark, dsn.database, keys or {}

    def tables(self) -> DataFrame:
        """table, row_count (from the footers) and total_bytes of every table."""
        names = sorted(n.removesuffix(".parquet") for n in os.listdir(self.folder) if n.endswith(".parquet"))
        rows = [(f"public.{n}", self.read(f"public.{n}").count(), self._bytes(f"{self.folder}/{n}.parquet")) for n in names]
        return self.spark.createDataFrame(rows, STATS_SCHEMA)

    @staticmethod
    def _bytes(path: str) -> int:
        return os.path.getsize(path) if os.path.isfile(path) else sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path))

    def read(self, table: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The live table."""
        df = self.spark.read.parquet(f"{self.folder}/{table.removeprefix('public.')}.parquet")
        return df.select(*columns) if columns else df

    def read_parallel(self, table: str) -> DataFrame:
        """The live table; files are split by Spark."""
        return self.read(table)

    def primary_key(self, table: str) -> list[str]:
        """As given at start."""
        return self.keys.get(table, [])


def connect(spark: SparkSession, dsn: str):
    """The source that a DSN names."""
    parsed = Dsn.parse(dsn)
    return FolderSource(spark, parsed) if parsed.kind == "parquet" else JdbcSource(spark, parsed)


def ranked(tables: DataFrame, k: int | None = None) -> DataFrame:
    """Tables by 0.6 x rows + 0.4 x MB, greatest first (names break ties); the first ``k`` if given."""
    score = F.round(F.col("row_count") * 0.6 + F.col("total_bytes") / (1 << 20) * 0.4, 6)
    out = tables.withColumn("score", score).orderBy(F.col("score").desc(), "table")
    return out.limit(k) if k is not None else out
