"""The engine: remote catalogs with snapshots, SQL over both, statistics and cached results."""

from __future__ import annotations

import datetime
import hashlib
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.accel.dsn import Dsn
from millrace.accel.policy import CachePolicy
from millrace.accel.remote import connect, ranked
from millrace.accel.script import statements
from millrace.accel.store import MetadataStore
from millrace.accel.tasks import Scheduler, TaskManager
from millrace.operators.dml import merged
from millrace.session import configure

# Column names that hold a row's last update, in lower case.
UPDATE_COLUMNS = ["lastupdatetime", "last_update_time", "last_updated", "last_modified", "updated_at", "update_time", "modified_at", "modify_time", "gmt_modified", "mtime"]
SMART_TOP, HOT_DAYS = 10, 7
UNSTABLE = re.compile(r"current_timestamp|current_date|localtimestamp|now\(|uuid|rand\(|randn\(|shuffle\(|current_user|monotonically|spark_partition|input_file", re.I)
TOKEN = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--[^\n]*|/\*.*?\*/)|((?:`[^`]+`|\w+)(?:\s*\.\s*(?:`[^`]+`|\w+)){2})(?:\s+(?:FOR\s+)?(?:SYSTEM_)?(VERSION|TIME(?:STAMP)?)\s+AS\s+OF\s+('[^']*'|\d+))?""", re.S | re.I)
CREATE = re.compile(r"^\s*CREATE\s+CATALOG\s+(\w+)\s+USING\s+(\S+?)(?:\s+COMMENT\s+'([^']*)')?(?:\s+PROPERTIES\s*\((.*)\))?\s*;?\s*$", re.I | re.S)


def _instant(text: str) -> str:
    """A time (UTC where no zone is given) as the store writes it."""
    at = datetime.datetime.fromisoformat(text)
    return (at if at.tzinfo else at.replace(tzinfo=datetime.UTC)).astimezone(datetime.UTC).isoformat()


class Engine:
    """Entry point of the acceleration layer.

    ``home`` holds metadata, snapshots and cached results; on a cluster it is a shared folder.
    A table is read from its newest snapshot if it has one, else live.
    """

    def __init__(self, spark: SparkSession, home: str, workers: int = 16, today=datetime.date.today, results: int = 256):
        self.spark, self.home, self.today = configure(spark), home.rstrip("/"), today
        self.store = MetadataStore(f"{self.home}/system")
        self.tasks = TaskManager(workers, spark=spark)
        self.sources: dict[str, object] = {}
        self.schedules: dict[str, Scheduler] = {}
        self.results: dict[str, tuple[DataFrame, str]] = {}
        self.most_results, self.hits = results, 0

    # catalogs

    def create_catalog(self, name: str, dsn: str, properties: dict[str, str] | None = None, comment: str | None = None, sync: bool = True, source=None, minutes: float | None = None) -> list[int]:
        """Register a remote database; sync it at once and, given ``minutes``, again and again. Returns the task ids."""
        policy = CachePolicy.from_properties(properties or {})
        kind = Dsn.parse(dsn).kind
        self.store.add_catalog(name, dsn, kind, comment, str(policy))
        if source is not None:
            self.sources[name] = source
        if minutes:
            self.schedules[name] = Scheduler(lambda: self.sync(name), minutes).start()
        return self.sync(name) if sync else []

    def drop_catalog(self, name: str) -> None:
        """Forget a catalog; its snapshots stay on disk."""
        if schedule := self.schedules.pop(name, None):
            schedule.stop()
        self.sources.pop(name, None)
        self.store.change("catalog", lambda records: records.pop(name))

    def source(self, catalog: str):
        """The catalog's connection."""
        if catalog not in self.sources:
            self.sources[catalog] = connect(self.spark, self.store.read("catalog")[catalog]["dsn"])
        return self.sources[catalog]

    # snapshots

    def planned(self, catalog: str) -> list[str]:
        """The tables that the catalog's policy asks for."""
        policy = CachePolicy.from_string(self.store.read("catalog")[catalog]["cache_policy"]).check()
        if policy.kind == "select":
            return policy.selected()
        tables = self.source(catalog).tables()
        if policy.kind == "all":
            return [r.table for r in tables.select("table").orderBy("table").collect()]
        top = [r.table for r in ranked(tables, policy.k if policy.kind == "topk" else SMART_TOP).collect()]
        hot = self.store.hot_tables(catalog, self.today(), HOT_DAYS) if policy.kind == "smart" else []
        return list(dict.fromkeys(top + hot))

    def sync(self, catalog: str, tables: list[str] | None = None) -> list[int]:
        """Queue a snapshot of each planned table; returns the task ids."""
        return [self.tasks.submit(f"sync {catalog}.{t}", lambda t=t: self.snapshot(catalog, t)) for t in (self.planned(catalog) if tables is None else tables)]

    def snapshot(self, catalog: str, table: str) -> int:
        """Copy a table to a new folder and make it current; readers of the old one are not disturbed. Returns the version."""
        return self._publish(catalog, table, self.source(catalog).read_parallel(table), "full")

    def _publish(self, catalog: str, table: str, df: DataFrame, how: str) -> int:
        path = f"{self.home}/remote_catalog/{catalog}/{table.replace('.', '/')}/{uuid.uuid4()}"
        df.write.parquet(path)
        return self.store.add_snapshot(catalog, table, path, df.schema.json(), {"how": how})

    def refresh(self, catalog: str, table: str, update_column: str | None = None) -> int:
        """Bring a snapshot up to date: rows changed since its latest update time are merged by primary key.

        Without key, update column or earlier snapshot, a full copy is made. Rows at the
        latest time are read again, so none is missed; deletions need a full copy now and then.
        """
        source, held = self.source(catalog), self.store.snapshots(catalog, table)
        live = source.read(table)
        names = {c.lower(): c for c in live.columns}
        column = update_column or next((names[c] for c in UPDATE_COLUMNS if c in names), None)
        keys = source.primary_key(table)
        if not (held and column and keys):
            return self.snapshot(catalog, table)
        old = self.spark.read.parquet(held[-1]["path"])
        latest = old.agg(F.max(column)).first()[0]
        fresh = live if latest is None else live.where((F.col(column) >= F.lit(latest).cast(live.schema[column].dataType)) | F.col(column).isNull())
        return self._publish(catalog, table, merged(old, fresh, keys), "incremental")

    def retire(self, catalog: str, table: str, keep: int = 2) -> int:
        """Delete all but the newest snapshots; returns how many."""
        gone = self.store.retire(catalog, table, keep)
        for path in gone:
            self._delete(path)
        return len(gone)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    # reading

    def table(self, name: str, version: int | None = None, as_of: str | None = None) -> DataFrame:
        """catalog.schema.table: the snapshot of a version or time, the newest one, or the live table. Counts a use."""
        catalog, _, table = name.partition(".")
        if catalog not in self.store.read("catalog"):
            raise KeyError(f"no catalog {catalog}")
        self.store.count_table(catalog, table, self.today())
        found = self._chosen(catalog, table, version, as_of)
        return self.spark.read.parquet(found["path"]) if found else self.source(catalog).read(table)

    def _chosen(self, catalog: str, table: str, version: int | None = None, as_of: str | None = None) -> dict | None:
        held = self.store.snapshots(catalog, table)
        if version is not None:
            held = [s for s in held if s["version"] == version]
        if as_of is not None:
            held = [s for s in held if s["at"] <= as_of]
        if not held and (version is not None or as_of is not None):
            raise KeyError(f"no such snapshot of {catalog}.{table}")
        return held[-1] if held else None

    def _routed(self, text: str) -> tuple[str, dict[str, int | None]]:
        """The statement with remote names replaced by views, and each name's snapshot version (None: live)."""
        catalogs, used = self.store.read("catalog"), {}

        def swap(match: re.Match) -> str:
            if match.group(1) or not match.group(2):
                return match.group(0)
            parts = [p.strip().strip("`") for p in re.split(r"\.(?=(?:[^`]*`[^`]*`)*[^`]*$)", match.group(2))]
            if parts[0] not in catalogs:
                return match.group(0)
            name, at, view = ".".join(parts), {}, "__".join(["millrace", *parts])
            if kind := match.group(3):
                value = match.group(4).strip("'")
                at = {"version": int(value)} if kind.upper() == "VERSION" else {"as_of": _instant(value)}
                view += "__" + re.sub(r"\W", "_", value)
            if view not in used:
                found = self._chosen(parts[0], ".".join(parts[1:]), **at)
                used[view] = found["version"] if found else None
                self.table(name, **at).createOrReplaceTempView(view)
            return f"`{view}`"

        return TOKEN.sub(swap, text), used

    def sql(self, text: str, cached: bool = True) -> DataFrame:
        """Run one statement. Remote tables are named catalog.schema.table; VERSION AS OF n or TIMESTAMP AS OF 'time' (UTC) after the name reads that snapshot.

        Every statement is counted under the hash of its canonical plan, so
        spelling does not matter. A SELECT over snapshots only, without functions that
        change from run to run, is answered from the cached result while the snapshots stay;
        the least lately used results go when there are more than ``results``.
        """
        if match := CREATE.match(text):
            name, dsn, comment, properties = match.groups()
            pairs = re.findall(r"['\"]?(\w+)['\"]?\s*=\s*['\"]?([^'\",]+(?:,[^'\",=]+(?![^,]*=))*)['\"]?", properties or "")
            self.tasks.wait_for(self.create_catalog(name, dsn.strip("'\""), {k: v.strip() for k, v in pairs}, comment))
            return self.catalogs()
        if match := re.match(r"^\s*SHOW\s+CATALOGS(?:\s+(?:LIKE\s+)?'([^']*)')?\s*;?\s*$", text, re.I):
            names = "|".join(p.strip().replace("*", ".*") for p in (match.group(1) or "*").split("|"))
            return self.catalogs().where(F.col("name").rlike(f"(?i)^({names})$"))
        began = time.monotonic()
        routed, used = self._routed(text)
        df = self.spark.sql(routed)
        plan = df._jdf.queryExecution().analyzed()
        canonical = plan.canonicalized().toString()
        key = hashlib.md5(canonical.encode()).hexdigest()[:20]
        names = re.findall(r"\b(?:FROM|JOIN)\s+(`?[\w.]+`?)", routed, re.I)
        whole = bool(used) and all(v is not None for v in used.values()) and plan.collectLeaves().size() <= len(re.findall("millrace__", routed)) and all(n.startswith("`millrace__") for n in names)
        out = df
        if cached and whole and plan.deterministic() and not UNSTABLE.search(canonical):
            entry = key + "/" + hashlib.md5(repr(sorted(used.items())).encode()).hexdigest()[:12]
            if entry in self.results:
                self.hits += 1
                self.results[entry] = self.results.pop(entry)
            else:
                path = f"{self.home}/results/{entry}-{uuid.uuid4().hex}"
                df.write.parquet(path)
                self.results[entry] = self.spark.read.schema(df.schema).parquet(path), path
                while len(self.results) > self.most_results:
                    self._delete(self.results.pop(next(iter(self.results)))[1])
            out = self.results[entry][0]
        self.store.count_query(key, text, int((time.monotonic() - began) * 1000))
        return out

    def script(self, text: str) -> list[DataFrame]:
        """Run the statements of a script, in turn."""
        return [self.sql(s) for s in statements(text)]

    # listings

    def catalogs(self) -> DataFrame:
        """Registered catalogs, without passwords."""
        rows = [(n, str(Dsn.parse(c["dsn"])), c["db_type"], c["description"], c["cache_policy"]) for n, c in sorted(self.store.read("catalog").items())]
        return self.spark.createDataFrame(rows, "name string, dsn string, db_type string, description string, cache_policy string")

    def sql_stats(self) -> DataFrame:
        """Statements with their counts and times."""
        rows = [(k, r["sql_text"], r["count"], r["execution_time"], r["min_time"], r["max_time"]) for k, r in self.store.read("sql_stats").items()]
        return self.spark.createDataFrame(rows, "sql_hash string, sql_text string, count int, execution_time bigint, min_time bigint, max_time bigint")

    def table_stats(self) -> DataFrame:
        """Uses of each table by day."""
        rows = [(r["catalog"], r["table"], r["stat_date"], r["query_count"]) for r in self.store.read("query_table_daily_stats").values()]
        return self.spark.createDataFrame(rows, "catalog string, table string, stat_date string, query_count int")

    def close(self) -> None:
        """Stop schedules and workers."""
        for s in self.schedules.values():
            s.stop()
        self.tasks.shutdown()
