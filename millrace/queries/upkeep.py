"""Queries of the data upkeep problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import change_feed, compaction, copy_diff, schema_drift, snapshot_diff
from millrace.operators.hashing import text_value, utc_naive
from millrace.session import scratch_path, stash
from millrace.sources.tables import load


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records added or changed since the last completed run of their source table."""
    keys = ["source_table", "row_key"]
    runs = load(spark, folder, "sync_task").where(F.lower(F.trim("status")) == "completed")
    last = runs.groupBy("source_table").agg(F.max(utc_naive(F.col("started_at"))).alias("ran_at"))
    updated = F.coalesce("lastupdatetime", "arrived_at")
    changes = load(spark, folder, "source_change")
    content = change_feed.content_hash([updated, *map(F.col, ("is_deleted", "qty", "amount", "state", "note"))])
    order = [updated, F.col("arrived_at"), F.col("change_id")]
    seen = changes.join(last, "source_table").where(F.col("arrived_at") <= F.col("ran_at"))
    store = change_feed.ChangeState(spark, scratch_path(spark, "p1-state"), tuple(keys))
    store.run(change_feed.latest(seen, keys, order, content, change_feed.HASH))  # the last completed run
    return store.run(change_feed.latest(changes, keys, order, content, change_feed.HASH)).select(*keys)


def _small_files(spark: SparkSession, folder: str) -> DataFrame:
    current = compaction.current_directories(load(spark, folder, "table_arrow_schema"))
    return compaction.small_files(load(spark, folder, "snapshot_file"), current)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Small data files of current directories, as the compaction plan assigns them."""
    return compaction.plan(_small_files(spark, folder), TARGET).select("file_id")


#: Bytes of an output file in the compaction queries; and of a file whose records the tables hold (TESTDATA: those below).
TARGET, READABLE = 16 << 20, 65_536


def p2_compact(spark: SparkSession, folder: str) -> DataFrame:
    """Compact every current directory: per directory the files taken (empty ones too), records and output files of the published manifest, and files refused."""
    files, rows = _small_files(spark, folder), load(spark, folder, "snapshot_row")
    checked = stash(compaction.held_against(files, compaction.contents(rows), READABLE), "p2-files")
    taken = checked.where("refused IS NULL")
    assigned = stash(compaction.plan(taken, TARGET), "p2-plan")
    out = scratch_path(spark, "p2")
    compaction.write_groups(assigned, rows, f"{out}/data").write.parquet(f"{out}/written")
    manifest = compaction.publish(spark.read.parquet(f"{out}/written"), assigned, checked, f"{out}/manifest")
    listed = checked.groupBy("directory").agg(F.count_if(F.expr("refused IS NULL")).alias("n_files"), F.count_if(F.expr("refused IS NOT NULL")).alias("n_refused"))
    made = manifest.groupBy("directory").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_outputs"))
    return listed.join(made, "directory", "left").select("directory", "n_files", "n_refused", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_rows", "n_outputs")])


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Output groups of the plan of each directory, and whether their loads differ by at most the largest file (each file being a bundle)."""
    files = _small_files(spark, folder)
    met = compaction.plan(files, TARGET, bundles=1 << 30).join(files.select("file_id", F.greatest("size_bytes", F.lit(1)).alias("size")), "file_id")
    loads = met.groupBy("directory", "output_group").agg(F.count("*").alias("n"), F.sum("size").alias("load"), F.max("size").alias("most"))
    return loads.groupBy("directory").agg(F.sum("n").alias("n_files"), F.count("*").alias("n_groups"), (F.max("load") - F.min("load") <= F.max("most")).alias("balanced"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that one copy lacks, and fields that differ, per source table."""
    paired = load(spark, folder, "sync_task").select("source_table", "local_table").dropna().distinct()
    plain = ["ratio", "is_open", "booked_on", "modified_at"]
    made = [text_value(F.col("code")).alias("code"), copy_diff.numeric_value(F.col("amount")).alias("amount"), F.col("qty").cast("bigint").alias("qty"), text_value(F.col("memo")).alias("memo")]
    source = load(spark, folder, "source_row").select("source_table", "row_key", *plain, *made)
    local = load(spark, folder, "local_row").join(paired, "local_table").select("source_table", "row_key", *plain, *made)
    fields = ["code", "amount", "qty", "ratio", "is_open", "booked_on", "modified_at", "memo"]
    return copy_diff.diff_copies(source, local, ["source_table", "row_key"], fields, {"ratio": 1e-9})


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of a column between consecutive schema versions of a table."""
    parsed = schema_drift.parse_versions(load(spark, folder, "table_arrow_schema"))
    return schema_drift.migration_steps(parsed).select("id", "field_name", "change")


def _consistent(spark: SparkSession, folder: str) -> DataFrame:
    parsed = schema_drift.parse_versions(load(spark, folder, "table_arrow_schema"), bare=True)
    return schema_drift.consistent_rows(parsed, load(spark, folder, "snapshot_file"), load(spark, folder, "snapshot_row"), compaction.directory)


def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All snapshot rows under the newest schema of their table; as raw JSON where that cannot be told."""
    record = F.map_from_arrays(F.col("record.field"), F.col("record.value"))
    return _consistent(spark, folder).withColumn("record", F.to_json(record, {"ignoreNullFields": "false"}))


def p4_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Every value that a cast of the way to the newest schema refused or altered."""
    return _consistent(spark, folder).select(*schema_drift.KEY, "file_id", "row_pos", F.explode("notes").alias("x")).select(*schema_drift.KEY, "file_id", "row_pos", "x.*")


def p4_tables(spark: SparkSession, folder: str) -> DataFrame:
    """One typed table written for each source table: its rows and columns."""
    out = scratch_path(spark, "p4")
    schema_drift.write_tables(_consistent(spark, folder), f"{out}/data").write.parquet(f"{out}/written")
    return spark.read.parquet(f"{out}/written").groupBy(*schema_drift.KEY).agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records added, removed or changed between consecutive complete snapshots."""
    complete = load(spark, folder, "table_snapshot").where("load_state = 'complete'")
    values = [text_value(F.col("code")), F.col("amount"), F.col("qty"), F.col("status"), text_value(F.col("memo"))]
    return snapshot_diff.change_events(complete, "source_table", "snapshot_no", ["row_key"], values, "loaded_at")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_compact": p2_compact, "p2_groups": p2_groups, "p3_found": p3_found, "p4_found": p4_found, "p4_rows": p4_rows, "p4_notes": p4_notes, "p4_tables": p4_tables, "p5_found": p5_found}

_DIR = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(local_path, '^file:(//)?', ''), '/+', '/', 'g'), '(/\.)+(/|$)', '\2', 'g'), '^(\./)+', ''), '/+$', '')"
_SMALL = f"""
        WITH v AS (SELECT *, {_DIR} AS dir FROM table_arrow_schema),
        cur AS (SELECT DISTINCT dir FROM (SELECT dir, row_number() OVER (PARTITION BY catalog_name, coalesce(schema_name, 'public'), table_name ORDER BY updated_at DESC NULLS LAST, id DESC) AS rn FROM v) WHERE rn = 1),
        f AS (SELECT DISTINCT file_id, size_bytes, row_count, {_DIR} AS dir FROM snapshot_file WHERE file_name LIKE '%.parquet' AND left(file_name, 1) NOT IN ('_', '.') AND size_bytes < 1048576),
        small AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dir) AS n FROM f WHERE dir IN (SELECT dir FROM cur)) WHERE n > 1)
        """
ORACLES = {
    "p1_found": """
        WITH runs AS (SELECT source_table, max(started_at AT TIME ZONE 'UTC') AS ran_at FROM sync_task
                      WHERE lower(trim(status, ' ')) = 'completed' GROUP BY source_table),
        d AS (SELECT DISTINCT c.*, coalesce(lastupdatetime, arrived_at) AS updated, coalesce(arrived_at <= ran_at, false) AS seen
              FROM source_change c LEFT JOIN runs USING (source_table)),
        o AS (SELECT *, row_number() OVER (PARTITION BY source_table, row_key ORDER BY updated DESC NULLS LAST, arrived_at DESC NULLS LAST, change_id DESC) AS rn_all,
                     row_number() OVER (PARTITION BY source_table, row_key, seen ORDER BY updated DESC NULLS LAST, arrived_at DESC NULLS LAST, change_id DESC) AS rn_seen FROM d),
        a AS (SELECT * FROM o WHERE rn_all = 1), s AS (SELECT * FROM o WHERE seen AND rn_seen = 1)
        SELECT a.source_table, a.row_key FROM a LEFT JOIN s ON a.source_table IS NOT DISTINCT FROM s.source_table AND a.row_key IS NOT DISTINCT FROM s.row_key
        WHERE s.change_id IS NULL OR (a.updated, a.is_deleted, a.qty, a.amount, a.state, a.note) IS DISTINCT FROM (s.updated, s.is_deleted, s.qty, s.amount, s.state, s.note)""",
    "p2_found": _SMALL + "SELECT file_id FROM small",
    "p2_groups": _SMALL + f"SELECT dir AS directory, count(*) AS n_files, greatest(1, (sum(size_bytes) + {TARGET - 1}) // {TARGET})::BIGINT AS n_groups, true AS balanced FROM small GROUP BY dir",
    "p2_compact": _SMALL + f"""
        , r AS (SELECT file_id, count(DISTINCT row_pos) AS held FROM snapshot_row GROUP BY file_id),
        t AS (SELECT dir, file_id, size_bytes, coalesce(held, 0) AS held, size_bytes < {READABLE} AND (row_count IS NULL OR row_count = coalesce(held, 0)) AS taken FROM small LEFT JOIN r USING (file_id))
        SELECT dir AS directory, count(*) FILTER (WHERE taken) AS n_files, count(*) FILTER (WHERE NOT taken) AS n_refused, coalesce(sum(held) FILTER (WHERE taken), 0)::BIGINT AS n_rows,
               CASE WHEN coalesce(sum(held) FILTER (WHERE taken), 0) = 0 THEN 0 ELSE greatest(1, (sum(size_bytes) FILTER (WHERE taken) + {TARGET - 1}) // {TARGET}) END::BIGINT AS n_outputs
        FROM t GROUP BY dir""",
    "p3_found": """
        WITH m AS (SELECT DISTINCT source_table, local_table FROM sync_task WHERE source_table IS NOT NULL AND local_table IS NOT NULL),
        s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_table, row_key) AS rn FROM source_row WHERE source_table IS NOT NULL AND row_key IS NOT NULL) WHERE rn = 1),
        l AS (SELECT * FROM (SELECT m.source_table, local_row.*, row_number() OVER (PARTITION BY m.source_table, row_key) AS rn FROM local_row JOIN m USING (local_table) WHERE row_key IS NOT NULL) WHERE rn = 1),
        b AS (SELECT s.source_table, s.row_key,
                rtrim(s.code, ' ') IS DISTINCT FROM rtrim(l.code, ' ') AS code, CAST(trim(s.amount) AS DECIMAL(38,10)) IS DISTINCT FROM CAST(l.amount AS DECIMAL(38,10)) AS amount, s.qty IS DISTINCT FROM l.qty AS qty,
                CASE WHEN s.ratio IS NULL OR l.ratio IS NULL THEN (s.ratio IS NULL) <> (l.ratio IS NULL) ELSE abs(s.ratio - l.ratio) > 0.000000001 END AS ratio,
                s.is_open IS DISTINCT FROM l.is_open AS is_open, s.booked_on IS DISTINCT FROM l.booked_on AS booked_on, s.modified_at IS DISTINCT FROM l.modified_at AS modified_at, rtrim(s.memo, ' ') IS DISTINCT FROM rtrim(l.memo, ' ') AS memo
              FROM s JOIN l ON s.source_table = l.source_table AND s.row_key = l.row_key)
        SELECT source_table, row_key, 'only_source' AS finding FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.source_table = s.source_table AND l.row_key = s.row_key)
        UNION ALL SELECT source_table, row_key, 'only_local' FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE l.source_table = s.source_table AND l.row_key = s.row_key)
        UNION ALL SELECT source_table, row_key, finding FROM (UNPIVOT b ON code, amount, qty, ratio, is_open, booked_on, modified_at, memo INTO NAME finding VALUE differs) WHERE differs""",
    "p5_found": """
        WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_table, snapshot_no, row_key ORDER BY loaded_at DESC NULLS LAST) AS rn FROM table_snapshot WHERE load_state = 'complete' AND row_key IS NOT NULL) WHERE rn = 1),
        n AS (SELECT source_table, snapshot_no, lead(snapshot_no) OVER (PARTITION BY source_table ORDER BY snapshot_no) AS later FROM (SELECT DISTINCT source_table, snapshot_no FROM table_snapshot WHERE load_state = 'complete')),
        a AS (SELECT c.source_table, n.later AS snapshot_no, row_key, code, amount, qty, status, memo FROM c JOIN n USING (source_table, snapshot_no) WHERE later IS NOT NULL),
        b AS (SELECT c.* FROM c JOIN n ON c.source_table = n.source_table AND c.snapshot_no = n.later)
        SELECT source_table, snapshot_no, row_key, CASE WHEN a.seen IS NULL THEN 'added' WHEN b.seen IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM (SELECT *, 1 AS seen FROM a) a FULL JOIN (SELECT *, 1 AS seen FROM b) b USING (source_table, snapshot_no, row_key)
        WHERE a.seen IS NULL OR b.seen IS NULL OR rtrim(a.code, ' ') IS DISTINCT FROM rtrim(b.code, ' ') OR a.amount IS DISTINCT FROM b.amount OR a.qty IS DISTINCT FROM b.qty
           OR a.status IS DISTINCT FROM b.status OR rtrim(a.memo, ' ') IS DISTINCT FROM rtrim(b.memo, ' ')""",
}
