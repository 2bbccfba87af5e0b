"""The metadata store: catalogs, snapshots, statement and table statistics, in one folder of small JSON files."""

from __future__ import annotations

import datetime
import json
import os
import threading
import uuid


class MetadataStore:
    """Small driver-side records; every change replaces one file by rename, so readers see all of it or none."""

    KINDS = ("catalog", "table_arrow_schema", "sql_stats", "query_table_daily_stats")

    def __init__(self, folder: str):
        self.folder, self.lock = folder.removeprefix("file://"), threading.RLock()
        if "://" in self.folder:
            raise ValueError(f"the metadata store needs a folder of the driver's file system (which may be a shared mount), not {folder}")
        os.makedirs(self.folder, exist_ok=True)

    def read(self, kind: str) -> dict[str, dict]:
        """All records of a kind by key."""
        path = f"{self.folder}/{kind}.json"
        if not os.path.exists(path):
            return {}
        with open(path) as f:
            return json.load(f)

    def change(self, kind: str, apply) -> dict:
        """Apply a function to a kind's records and write them; returns what the function returns."""
        with self.lock:
            records = self.read(kind)
            out = apply(records)
            aside = f"{self.folder}/{kind}.{uuid.uuid4().hex}"
            with open(aside, "w") as f:
                json.dump(records, f)
            os.replace(aside, f"{self.folder}/{kind}.json")
            return out

    def add_catalog(self, name: str, dsn: str, db_type: str, description: str | None, policy: str) -> None:
        """Register a catalog; a name in use is an error."""

        def apply(records):
            if name in records:
                raise ValueError(f"catalog {name} exists")
            records[name] = {"dsn": dsn, "db_type": db_type, "description": description, "cache_policy": policy}

        self.change("catalog", apply)

    def add_snapshot(self, catalog: str, table: str, path: str, schema: str, info: dict) -> int:
        """Make a snapshot the current one of its table; returns its version. Earlier ones stay listed until retired."""

        def apply(records):
            versions = records.setdefault(f"{catalog}.{table}", {"versions": []})["versions"]
            number = versions[-1]["version"] + 1 if versions else 1
            versions.append({"version": number, "path": path, "schema": schema, "at": datetime.datetime.now(datetime.UTC).isoformat(), **info})
            return number

        return self.change("table_arrow_schema", apply)

    def snapshots(self, catalog: str, table: str) -> list[dict]:
        """Snapshots of a table, oldest first."""
        return self.read("table_arrow_schema").get(f"{catalog}.{table}", {"versions": []})["versions"]

    def retire(self, catalog: str, table: str, keep: int) -> list[str]:
        """Drop all but the newest ``keep`` snapshots from the list; returns their paths, to delete after a grace time."""

        def apply(records):
            held = records.get(f"{catalog}.{table}", {"versions": []})
            gone, held["versions"] = held["versions"][:-keep], held["versions"][-keep:]
            return [v["path"] for v in gone]

        return self.change("table_arrow_schema", apply)

    def count_query(self, key: str, text: str, ms: int) -> None:
        """Add a run to a statement's statistics."""

        def apply(records):
            r = records.setdefault(key, {"sql_text": text, "execution_time": 0, "count": 0, "min_time": ms, "max_time": ms})
            r.update(execution_time=r["execution_time"] + ms, count=r["count"] + 1, min_time=min(r["min_time"], ms), max_time=max(r["max_time"], ms))

        self.change("sql_stats", apply)

    def count_table(self, catalog: str, table: str, day: datetime.date) -> None:
        """Count a use of a table on a day."""

        def apply(records):
            key = f"{catalog}.{table}@{day.isoformat()}"
            records[key] = {"catalog": catalog, "table": table, "stat_date": day.isoformat(), "query_count": records.get(key, {"query_count": 0})["query_count"] + 1}

        self.change("query_table_daily_stats", apply)

    def hot_tables(self, catalog: str, today: datetime.date, days: int = 7) -> list[str]:
        """Tables used in the last days, sorted."""
        since = (today - datetime.timedelta(days=days)).isoformat()
        return sorted({r["table"] for r in self.read("query_table_daily_stats").values() if r["catalog"] == catalog and r["stat_date"] >= since})
