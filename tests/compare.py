"""Hold a query against its SQL twin, as the driver does: names, rows, values."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sync_task table_arrow_schema snapshot_file snapshot_row source_change source_row local_row table_snapshot eval_item".split()


def plain(v):
    """A value in one form for both engines."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def oracle_rows(sql: str, folder: str):
    """Column names and rows of the SQL twin."""
    with duckdb.connect() as con:
        con.execute("SET TimeZone='UTC'")
        for t in TABLES:
            if os.path.exists(f"{folder}/{t}.parquet"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        r = con.execute(sql)
        return [d[0] for d in r.description], r.fetchall()


def difference(spark, query, sql: str, folder: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, folder)
    names, rows = oracle_rows(sql, folder)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    ours = Counter(tuple(plain(r[n]) for n in order) for r in df.select(*[f"`{n}`" for n in order]).collect())
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rows)
    if ours == theirs:
        return ""
    return f"{order}: {sum(ours.values())} rows against {sum(theirs.values())}; only Spark {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from millrace import get_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    session = get_session(master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        began = time.time()
        try:
            if name in oracles:
                said = difference(session, queries[name], oracles[name], folder) or "same"
            else:
                said = f"no SQL, {queries[name](session, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += not said.startswith(("same", "no SQL"))
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    print("BAD", bad)
