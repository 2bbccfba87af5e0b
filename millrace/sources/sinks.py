"""Writing to catalog tables: create, append, replace, overwrite by condition or by partition, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from millrace.operators.dml import _publish


class TableWriter:
    """Writes a DataFrame to a parquet table of the session catalog."""

    def __init__(self, df: DataFrame, table: str, partition_by: Sequence[str] = (), bucket_by: tuple[int, Sequence[str]] | None = None, sort_by: Sequence[str] = (), fmt: str = "parquet"):
        self.df, self.table, self.spark = df, table, df.sparkSession
        self.partition_by, self.bucket_by, self.sort_by, self.fmt = list(partition_by), bucket_by, list(sort_by), fmt

    def _writer(self, mode: str):
        w = self.df.write.format(self.fmt).mode(mode)
        if self.partition_by:
            w = w.partitionBy(*self.partition_by)
        if self.bucket_by:
            w = w.bucketBy(self.bucket_by[0], *self.bucket_by[1])
            if self.sort_by:
                w = w.sortBy(*self.sort_by)
        return w

    def create(self) -> None:
        """Create the table; it must not exist."""
        self._writer("errorifexists").saveAsTable(self.table)

    def create_or_replace(self) -> None:
        """Create the table, in place of one that exists."""
        self._writer("overwrite").saveAsTable(self.table)

    def replace(self) -> None:
        """Replace a table that must exist."""
        if not self.spark.catalog.tableExists(self.table):
            raise AnalysisException(f"table {self.table} does not exist")
        self.create_or_replace()

    def append(self) -> None:
        """Add rows; columns are matched by name, and must be those of the table."""
        columns = self.spark.table(self.table).columns
        if {c.lower() for c in columns} != {c.lower() for c in self.df.columns}:
            raise AnalysisException(f"columns {self.df.columns} are not those of {self.table}: {columns}")
        self.df.select(*columns).write.insertInto(self.table)

    def overwrite_partitions(self) -> None:
        """Replace the partitions of which there are rows; the others stay."""
        columns = self.spark.table(self.table).columns
        old = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            self.df.select(*columns).write.insertInto(self.table, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)

    def overwrite(self, condition: Column) -> None:
        """Replace the rows under a condition (of a table without partitions): copy on write."""
        table = self.spark.table(self.table)
        path = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").where("col_name = 'Location'").first().data_type
        _publish(table.where(~F.coalesce(condition, F.lit(False))).unionByName(self.df.select(*table.columns)), path)
        self.spark.catalog.refreshTable(self.table)


def drop(spark: SparkSession, table: str) -> None:
    """Drop a table if it is there."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
