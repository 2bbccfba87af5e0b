"""The acceleration layer: policies, names of databases, tasks, schedule, snapshots over JDBC."""

import datetime
import threading
import time
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.accel.dsn import Dsn
from millrace.accel.engine import Engine
from millrace.accel.policy import CachePolicy, PolicyError
from millrace.accel.remote import ranked
from millrace.accel.store import MetadataStore
from millrace.accel.tasks import Scheduler, TaskManager
from millrace.sources import formats


@pytest.mark.parametrize("text", ["all", "smart", "topk:k=3", "topk:k=0", "select:table_set=a.b,c.d", "select:table_set="])
def test_policies_round_trip(text):
    assert str(CachePolicy.from_string(text)) == text


@pytest.mark.parametrize(
    ("text", "kind"), [("unknown", "InvalidCachePolicy"), ("x:y", "InvalidCachePolicy"), ("topk:n=1", "KValueNotFound"), ("topk:k=-1", "InvalidKValue"), ("topk:k=x", "InvalidKValue"), ("topk:k=4294967296", "InvalidKValue"), ("select:", "TableSetNotFound")]
)
def test_bad_policy_texts(text, kind):
    with pytest.raises(PolicyError) as e:
        CachePolicy.from_string(text)
    assert e.value.kind == kind


@pytest.mark.parametrize(
    ("given", "kind"), [({"cache_policy": "topk"}, "KValueNotFound"), ({"cache_policy": "topk", "k": "0"}, "InvalidKValue"), ({"cache_policy": "select"}, "TableSetNotFound"), ({"cache_policy": "select", "table_set": ""}, "InvalidTableSetValue"), ({"cache_policy": "z"}, "InvalidCachePolicy")]
)
def test_bad_policy_properties(given, kind):
    with pytest.raises(PolicyError) as e:
        CachePolicy.from_properties(given)
    assert e.value.kind == kind


def test_empty_policy_is_smart():
    assert CachePolicy.from_string("").kind == CachePolicy.from_properties({}).kind == "smart"


def test_dsn():
    d = Dsn.parse("postgres://me:p%40ss@10.0.0.1:5432/shop?sslmode=require")
    assert d.jdbc() == ("jdbc:postgresql://10.0.0.1:5432/shop?sslmode=require", {"user": "me", "password": "p@ss"})
    assert "p@ss" not in str(d)
    for bad in ("ftp://h/d", "postgres:///d", "postgres://h"):
        with pytest.raises(ValueError):
            Dsn.parse(bad)


def test_no_task_is_dropped_above_capacity():
    manager, seen = TaskManager(workers=2, queued=4, wait=0.01), []
    ids = [manager.submit(f"t{i}", lambda i=i: (time.sleep(0.005), seen.append(i))) for i in range(40)]
    assert {t.status for t in manager.wait_for(ids, 10)} == {"completed"} and sorted(seen) == list(range(40))
    manager.shutdown()
    with pytest.raises(RuntimeError):
        manager.submit("late", lambda: None)


def test_failures_are_tried_again_and_then_reported():
    manager, tries = TaskManager(workers=1, retries=2, wait=0.01), []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ValueError("once more")
        return "done"

    def broken():
        raise KeyError("never")

    a, b = manager.wait_for([manager.submit("a", flaky), manager.submit("b", broken)], 10)
    assert (a.status, a.result, a.retries) == ("completed", "done", 2) and b.status == "failed" and "never" in b.error
    manager.shutdown()


def test_priority_and_cancel():
    manager, order, gate = TaskManager(workers=1, wait=0.01), [], threading.Event()
    first = manager.submit("gate", gate.wait)
    time.sleep(0.05)
    ids = [manager.submit(p, lambda p=p: order.append(p), p) for p in ("low", "normal", "high")]
    gone = manager.submit("gone", lambda: order.append("gone"))
    assert manager.cancel(gone)
    gate.set()
    manager.wait_for([first, *ids, gone], 10)
    assert order == ["high", "normal", "low"] and manager.tasks[gone].status == "cancelled" and not manager.cancel(first)
    manager.shutdown()


def test_schedule_with_a_fake_clock():
    clock, runs = [0.0], []
    s = Scheduler(lambda: runs.append(clock[0]), 60, lambda: clock[0])
    assert not s.tick()
    clock[0] = 3600
    assert s.tick() and not s.tick()
    clock[0] = 4 * 3600 + 5
    assert s.tick() and not s.tick() and len(runs) == 2


def test_hot_tables_by_day(tmp_path):
    store, today = MetadataStore(str(tmp_path)), datetime.date(2024, 1, 10)
    store.count_table("c", "s.new", today - datetime.timedelta(days=7))
    store.count_table("c", "s.old", today - datetime.timedelta(days=8))
    store.count_table("d", "s.other", today)
    assert store.hot_tables("c", today) == ["s.new"]


def test_ranking(spark):
    df = spark.createDataFrame([("a", 10, 0), ("b", 0, 15 << 20), ("c", 10, 0), ("d", 9, 100 << 20)], "table STRING, row_count BIGINT, total_bytes BIGINT")
    assert [r.table for r in ranked(df).collect()] == ["d", "a", "b", "c"] and ranked(df, 1).count() == 1


@pytest.fixture
def derby(spark):
    name = f"memory:m{uuid.uuid4().hex[:8]}"
    connection = spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{name};create=true")
    run = connection.createStatement().executeUpdate
    run("CREATE SCHEMA S")
    run("CREATE TABLE S.ITEM (ID INT NOT NULL PRIMARY KEY, NAME VARCHAR(20), UPDATED_AT TIMESTAMP)")
    run("CREATE TABLE S.PLAIN (X INT)")
    run("INSERT INTO S.ITEM VALUES (1, 'a', TIMESTAMP('2024-01-01 00:00:00')), (2, 'b', TIMESTAMP('2024-01-02 00:00:00')), (3, NULL, NULL)")
    run("INSERT INTO S.PLAIN VALUES (1), (1)")
    yield name, run
    connection.close()


def test_snapshots_over_jdbc(spark, derby, tmp_path):
    name, run = derby
    engine = Engine(spark, str(tmp_path), workers=2)
    out = engine.sql(f"CREATE CATALOG shop USING derby://{name} COMMENT 'test' PROPERTIES(cache_policy='topk', k=1)")
    assert out.first().cache_policy == "topk:k=1"
    assert engine.store.snapshots("shop", "S.ITEM") and not engine.store.snapshots("shop", "S.PLAIN")
    text = "SELECT ID, NAME FROM shop.S.ITEM WHERE ID < 3"
    assert engine.sql(text).count() == 2
    run("UPDATE S.ITEM SET NAME = 'z', UPDATED_AT = TIMESTAMP('2024-03-01 00:00:00') WHERE ID = 1")
    run("INSERT INTO S.ITEM VALUES (4, 'd', TIMESTAMP('2024-03-02 00:00:00'))")
    assert {tuple(r) for r in engine.sql(text).collect()} == {(1, "a"), (2, "b")} and engine.hits == 1
    assert engine.refresh("shop", "S.ITEM") == 2
    assert {tuple(r) for r in engine.sql(text).collect()} == {(1, "z"), (2, "b")}
    assert engine.table("shop.S.ITEM").count() == 4 and engine.table("shop.S.ITEM", version=1).count() == 3
    assert engine.store.snapshots("shop", "S.ITEM")[-1]["how"] == "incremental"
    assert engine.sql("SELECT count(*) AS n FROM shop.S.PLAIN").first().n == 2
    assert "PushedFilters: [*IsNotNull(ID), *LessThan(ID,2)]" in engine.source("shop").read("S.ITEM").where("ID < 2")._jdf.queryExecution().toString()
    assert engine.source("shop").primary_key("S.ITEM") == ["ID"]
    assert engine.retire("shop", "S.ITEM", keep=1) == 1
    with pytest.raises(KeyError):
        engine.table("shop.S.ITEM", version=1)
    engine.close()


def test_unstable_statements_are_not_cached(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path), workers=1)
    engine.tasks.wait_for(engine.create_catalog("c", f"parquet://{folder}", {"cache_policy": "select", "table_set": "public.region"}))
    for text in ("SELECT rand() AS r FROM c.public.region", "SELECT current_timestamp() AS t FROM c.public.region", "SELECT * FROM c.public.nation", "SELECT 'c.public.region' AS s"):
        engine.sql(text).collect()
        engine.sql(text).collect()
    assert engine.hits == 0 and engine.sql("SELECT 'c.public.region' AS s").first().s == "c.public.region"
    with pytest.raises(ValueError):
        engine.create_catalog("c", f"parquet://{folder}")
    engine.drop_catalog("c")
    assert engine.catalogs().count() == 0
    assert F.col("x") is not None
    engine.close()


def test_arrow_files_of_several_schemas_keep_every_column(spark, tmp_path):
    def save(name, table):
        with pa.ipc.new_file(str(tmp_path / name), table.schema) as writer:
            writer.write_table(table)

    with pytest.raises(FileNotFoundError):
        formats.read_arrow(spark, [str(tmp_path)])
    save("a.arrow", pa.table({"k": [1], "a": ["x"]}))
    save("b.arrow", pa.table({"b": [2.5], "k": [2]}))
    got = formats.read_arrow(spark, [f"file://{tmp_path}"])
    assert {(r.k, r.a, r.b) for r in got.collect()} == {(1, "x", None), (2, None, 2.5)}
    save("c.arrow", pa.table({"k": ["text"]}))
    with pytest.raises(pa.ArrowTypeError):
        formats.read_arrow(spark, [str(tmp_path)])


def test_catalogs_by_pattern_and_snapshots_by_time(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path), workers=1)
    for name in ("shop_a", "shop_b", "other"):
        engine.create_catalog(name, f"parquet://{folder}", {"cache_policy": "select", "table_set": "public.region"}, sync=False)
    assert [r.name for r in engine.sql("SHOW CATALOGS LIKE 'shop*'").orderBy("name").collect()] == ["shop_a", "shop_b"] and engine.sql("SHOW CATALOGS").count() == 3
    engine.snapshot("shop_a", "public.region")
    assert engine.sql("SELECT a.* FROM shop_a.public.region VERSION AS OF 1 a").count() == 5
    assert engine.sql("SELECT * FROM shop_a.public.region FOR SYSTEM_TIME AS OF '2999-01-01'").count() == 5
    for late in ("VERSION AS OF 2", "TIMESTAMP AS OF '2001-01-01 00:00:00'"):
        with pytest.raises(KeyError):
            engine.sql(f"SELECT * FROM shop_a.public.region {late}")
    with pytest.raises(ValueError, match="metadata store"):
        Engine(spark, "hdfs://nn/home")
    engine.close()
