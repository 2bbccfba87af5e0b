"""The data upkeep operators on small fixtures: nulls, empty tables, ties, repeats, hot keys, failures."""

import datetime as dt
import random
import threading
from collections import Counter
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators import change_feed, compaction, copy_diff, heavy, schema_drift, snapshot_diff
from millrace.operators.adjacent import with_previous, with_previous_of
from millrace.operators.hashing import content_hash, text_value, utc_naive
from millrace.operators.presence import PresenceBitmap
from millrace.operators.sieve import Sieve, key_hash
from millrace.session import stash


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# content hashes


def test_content_hash_tells_nulls_from_values(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None), (1, 1), (0, 0)], "a INT, b INT").select(content_hash([F.col("a"), F.col("b")]).alias("h"))
    assert len({r.h for r in df.collect()}) == 5


def test_utc_naive_ignores_the_session_zone(spark):
    df = spark.sql("SELECT timestamp'2024-01-01T12:00:00Z' AS t")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert df.select(utc_naive(F.col("t"))).first()[0] == dt.datetime(2024, 1, 1, 12)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# new and changed records


def state(spark, tmp_path, keys=("k",)):
    return change_feed.ChangeState(spark, f"file://{tmp_path}/state", keys)


def hashed(spark, data):
    return change_feed.hashed(spark.createDataFrame(data, "k INT, v STRING"), ["k"], ["v"])


def test_only_new_and_changed_rows_come_out(spark, tmp_path):
    store = state(spark, tmp_path)
    assert {r.change for r in store.run(hashed(spark, [(1, "a"), (None, "n"), (3, None)])).collect()} == {"new"} and store.version() == 1
    second = hashed(spark, [(1, "a"), (None, "m"), (3, ""), (4, "d")])
    assert {(r.k, r.change) for r in store.run(second).collect()} == {(None, "changed"), (3, "changed"), (4, "new")}
    assert store.run(second).count() == 0 and store.version() == 3
    assert store.prune(1) == 2 and store.prune(1) == 0 and store.read()[1].count() == 4


def test_a_failed_run_leaves_the_state_and_repeats_its_rows(spark, tmp_path):
    store, done = state(spark, tmp_path), []

    def fail(found):
        raise ValueError("lost")

    store.run(hashed(spark, [(1, "a")]), lambda found: done.extend(r.k for r in found.collect()))
    more = hashed(spark, [(1, "a"), (2, "b")])
    with pytest.raises(ValueError, match="lost"):
        store.run(more, fail)
    with pytest.raises(Exception, match="broken"):
        store.run(more.withColumn(change_feed.HASH, F.raise_error(F.lit("broken")).cast("bigint")))
    assert store.version() == 1
    store.run(more, lambda found: done.extend(r.k for r in found.collect()))
    assert done == [1, 2] and store.version() == 2


def test_of_two_runs_that_read_one_version_one_is_refused(spark, tmp_path):
    store = state(spark, tmp_path)
    store.run(hashed(spark, [(1, "a")]))
    (first, _), (second, _) = store.read(), store.read()
    store.swap(hashed(spark, [(1, "a"), (2, "b")]), first)
    with pytest.raises(RuntimeError, match="another run"):
        store.swap(hashed(spark, [(1, "a"), (3, "c")]), second)
    assert store.version() == 2 and rows(store.read()[1].select("k")) == [(1,), (2,)]


def test_of_racing_threads_one_swaps(spark, tmp_path):
    store, won = state(spark, tmp_path), []
    frame = hashed(spark, [(1, "a")])

    def race():
        try:
            won.append(store.swap(frame, 0))
        except RuntimeError:
            won.append(None)

    threads = [threading.Thread(target=race) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won, key=str) == [1, None, None, None]


def test_latest_breaks_ties_and_takes_nulls_as_least(spark):
    df = spark.createDataFrame([(1, None, 1, 10), (1, 5, 1, 20), (1, 5, 2, 30), (2, None, 1, 40)], "k INT, t INT, id INT, v INT")
    assert rows(change_feed.latest(df, ["k"], [F.col("t"), F.col("id")], F.col("v"), "v")) == [(1, 30), (2, 40)]
    assert change_feed.latest(df.limit(0), ["k"], [F.col("t")], F.col("v"), "v").count() == 0


# small files


@pytest.mark.parametrize(
    ("path", "want"),
    [("/a/b", "/a/b"), ("file:/a/b/", "/a/b"), ("file:///a//b", "/a/b"), ("//a/./b/././c/.", "/a/b/c"), ("./a/b", "a/b"), ("/a/.b/c.d", "/a/.b/c.d"), ("", ""), (None, None)],
)
def test_directories_have_one_spelling(spark, path, want):
    assert spark.createDataFrame([(path,)], "p STRING").select(compaction.directory(F.col("p"))).first()[0] == want


def test_schedule_is_balanced_and_complete():
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 1000) for _ in range(500)]
    placed = compaction.schedule(sizes, 7)
    loads = Counter()
    for size, g in zip(sizes, placed, strict=True):
        loads[g] += size
    assert len(loads) == 7 and max(loads.values()) - min(loads.values()) <= max(sizes)
    assert compaction.schedule([], 3) == [] and set(compaction.schedule([0] * 6, 3)) == {0, 1, 2}


LISTING = "file_id BIGINT, local_path STRING, file_name STRING, row_count BIGINT, size_bytes BIGINT"


def listing(spark):
    data = [
        (1, "/d/a", "1.parquet", 2, 100), (1, "/d/a", "1.parquet", 2, 100), (2, "file:/d/a/", "2.parquet", None, 0), (3, "/d/./a", "_3.parquet", 1, 10), (4, "/d/a", "4.parquet.crc", 1, 10), (5, "/d/a", None, 1, 10),
        (6, "/d/a", "6.parquet", 1, None), (7, "/d/a", "7.parquet", 9, 1 << 20), (8, "/d/alone", "8.parquet", 1, 5), (9, "/d/old", "9.parquet", 1, 5), (10, "/d/old", "10.parquet", 1, 5), (11, None, "11.parquet", 1, 5),
    ]
    return spark.createDataFrame(data, LISTING)


def test_small_files_of_current_directories(spark):
    versions = spark.createDataFrame(
        [(1, "c", None, "t", "/d/old", dt.datetime(2024, 1, 1)), (2, "c", "public", "t", "//d/a", dt.datetime(2024, 1, 2)), (3, "c", "s", "u", "/d/alone", dt.datetime(2024, 1, 2)), (4, "c", "s", "v", None, None)],
        "id INT, catalog_name STRING, schema_name STRING, table_name STRING, local_path STRING, updated_at TIMESTAMP_NTZ",
    )
    found = compaction.small_files(listing(spark), compaction.current_directories(versions))
    assert rows(found.select("directory", "file_id", "siblings")) == [("/d/a", 1, 2), ("/d/a", 2, 2)]
    assert compaction.plan(found.limit(0)).count() == 0


@pytest.mark.parametrize(("per_slice", "bundles"), [(500, 20), (100_000, 5000), (100_000, 300)])
def test_a_directory_is_balanced_over_slices(spark, per_slice, bundles):
    files = spark.range(5000).selectExpr("'/hot' AS directory", "id AS file_id", "id % 97 AS size_bytes", "5000L AS siblings")
    plan = compaction.plan(files, 10_000, per_slice, bundles).join(files.select("file_id", "size_bytes"), "file_id")
    loads = plan.groupBy("output_group").agg(F.sum(F.greatest("size_bytes", F.lit(1))).alias("load"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in loads) == plan.select("file_id").distinct().count() == 5000
    assert len(loads) == -(-sum(i % 97 for i in range(5000)) // 10_000)
    slices = -(-5000 // per_slice)
    largest = 96 if bundles >= 5000 else 2 * sum(i % 97 for i in range(5000)) // (slices * bundles) + 96
    assert max(r.load for r in loads) - min(r.load for r in loads) <= largest


FILES = "directory STRING, file_id BIGINT, size_bytes BIGINT, row_count BIGINT, siblings BIGINT"
ROWS = "file_id BIGINT, row_pos INT, row_json STRING"


def compacted(spark, tmp_path, files, table, target=700, kept=None):
    checked = stash(compaction.held_against(files, compaction.contents(table), 1000), "checked")
    plan = stash(compaction.plan(checked.where("refused IS NULL"), target), "plan")
    written = stash(compaction.write_groups(plan, table if kept is None else kept, f"file://{tmp_path}/out"), "w")
    return written, plan, checked


def test_compaction_keeps_every_record_and_publishes_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "ROW_GROUP", 3000)
    files = spark.createDataFrame([("/a" if f < 30 else "/b", f, 100, None if f % 2 else 4 if f != 38 else 0, 30 if f < 30 else 10) for f in range(40)], FILES)
    content = [(f, p, None if p == 2 else f'{{"f":{f},"p":{p},"t":"ü{"x" * (5000 if p == 1 else 1)}"}}') for f in range(40) for p in range(4) if f < 38]
    written, plan, checked = compacted(spark, tmp_path, files, spark.createDataFrame(content + content[:7], ROWS))
    manifest = compaction.publish(written, plan, checked, f"file://{tmp_path}/manifest")
    got = [tuple(r.values()) for m in manifest.collect() for r in pq.read_table(m.output_path).to_pylist()]
    assert sorted(got, key=repr) == sorted(content, key=repr)
    found = {m.directory: m for m in manifest.groupBy("directory").agg(F.sum("n_files").alias("f"), F.sum("n_rows").alias("r"), F.count("*").alias("n")).collect()}
    assert (found["/a"].f, found["/b"].f, found["/a"].n, found["/b"].n) == (30, 8, 5, 2) and len(got) == found["/a"].r + found["/b"].r
    assert spark.read.parquet(f"file://{tmp_path}/manifest-refused").count() == 0
    with pytest.raises(RuntimeError, match="another run"):
        compaction.publish(written, plan, checked, f"file://{tmp_path}/manifest")


def test_a_file_whose_content_is_missing_is_refused_by_name(spark, tmp_path):
    files = spark.createDataFrame([("/a", i, 2000 if i == 6 else 10, n, 8) for i, n in enumerate([1, 2, 0, None, None, 3, 1, 1])], FILES)
    table = spark.createDataFrame([(0, 0, "{}"), (0, 0, "{}"), (1, 0, "{}"), (3, 0, "{}"), (7, 0, "{}"), (7, 0, "[]")], ROWS)
    written, plan, checked = compacted(spark, tmp_path, files, table)
    manifest = compaction.publish(written, plan, checked, f"file://{tmp_path}/manifest")
    assert rows(plan.select("file_id")) == [(0,), (2,), (3,), (4,)] and manifest.agg(F.sum("n_rows")).first()[0] == 2
    assert rows(spark.read.parquet(f"file://{tmp_path}/manifest-refused").select("file_id", "row_count", "n_rows", "refused")) == [
        (1, 2, 1, "other count than listed"), (5, 3, 0, "other count than listed"), (6, 1, 0, "not readable"), (7, 1, 1, "two records at one position"),
    ]


def test_a_planned_file_that_is_lost_stops_the_manifest(spark, tmp_path):
    files = spark.createDataFrame([("/a", 0, 10, 1, 3), ("/a", 1, 10, 1, 3), ("/a", 2, 10, None, 3)], FILES)
    table = spark.createDataFrame([(0, 0, "{}"), (1, 0, "{}")], ROWS)
    written, plan, checked = compacted(spark, tmp_path, files, table, kept=table.limit(1))
    with pytest.raises(RuntimeError, match="differ"):
        compaction.publish(written, plan, checked, f"file://{tmp_path}/manifest")
    whole, plan, checked = compacted(spark, tmp_path / "2", files, table)
    unlisted = spark.createDataFrame([("/a", 0, 99)], "directory STRING, output_group INT, file_id BIGINT")
    with pytest.raises(RuntimeError, match="differ"):
        compaction.publish(whole, plan.unionByName(unlisted), checked, f"file://{tmp_path}/manifest")
    with pytest.raises(RuntimeError, match="differ"):
        compaction.publish(whole, plan, checked.where("file_id <> 1"), f"file://{tmp_path}/manifest")
    assert not (tmp_path / "manifest").exists()
    assert compaction.publish(whole, plan, checked, f"file://{tmp_path}/manifest").count() == 1


# two copies


def test_presence_bitmaps_equal_sets():
    rnd = random.Random(2)
    for n in (0, 3, 5000, 90_000):
        a, b = ({rnd.randrange(200_000) for _ in range(n)} for _ in range(2))
        x, y = PresenceBitmap.of(list(a)), PresenceBitmap.of(list(b))
        assert x.and_not(y).to_array().tolist() == sorted(a - b)
        assert x.intersect(y).to_array().tolist() == sorted(a & b)


SIDE = "t STRING, k BIGINT, a DECIMAL(38,18), r DOUBLE, s STRING, d DATE, extra STRING"


def side(spark, data):
    return spark.createDataFrame([(t, k, None if a is None else Decimal(a), r, s, d, "x") for t, k, a, r, s, d in data], SIDE).withColumn("s", text_value(F.col("s")))


def test_differences_by_field(spark):
    nan, day = float("nan"), dt.date(2024, 1, 1)
    left = side(spark, [("t", 1, "1.50", 1.0, "a  ", day), ("t", 2, "1", nan, "", None), ("t", 3, None, None, None, day), ("t", None, "1", 1.0, "a", day), ("u", 1, "1", 1.0, "é", day), ("t", 9, "1", 1.0, "a", day), ("t", 9, "1", 1.0, "a ", day)])
    right = side(spark, [("t", 1, "1.5", 1.0 + 1e-10, "a", day), ("t", 2, "2", nan, None, None), ("t", 3, None, 0.0, None, None), ("u", 2, "1", 1.0, "a", day), ("t", 9, "1", 1.1, "a", day)])
    want = [("t", 2, "a"), ("t", 2, "s"), ("t", 3, "d"), ("t", 3, "r"), ("t", 9, "r"), ("u", 1, "only_source"), ("u", 2, "only_local")]
    for chunk in (1, 5, 65_536):
        assert rows(copy_diff.diff_copies(left, right, ["t", "k"], ["a", "r", "s", "d"], {"r": 1e-9}, chunk)) == sorted(want, key=repr)
    assert {r.finding for r in copy_diff.diff_copies(left, right.limit(0), ["t", "k"], ["a"]).collect()} == {"only_source"}
    assert copy_diff.diff_copies(left.limit(0), right.limit(0), ["t", "k"], ["a"]).count() == 0


def test_a_repeated_key_does_not_fill_a_chunk(spark):
    df = spark.range(6000).selectExpr("'t' AS t", "if(id < 3000, 7, id) AS k", "'v' AS v").repartition(5)
    made = copy_diff.chunked(df.union(df.selectExpr("t", "NULL", "v")), ["t", "k"], ["v"], 3)
    assert made.where("k1 = 7").count() == 1 and made.count() == made.select("k0", "k1").distinct().count() == 3001
    assert rows(copy_diff.diff_copies(df, df.where("k <> 7 AND k <> 5000"), ["t", "k"], ["v"])) == [("t", 5000, "only_source"), ("t", 7, "only_source")]


def test_a_chunk_spans_several_containers(spark):
    left, right = spark.range(0, 150_000).selectExpr("id AS k", "id % 7 AS v"), spark.range(100_000, 230_000).selectExpr("id AS k", "if(id % 9999 = 0, -1, id % 7) AS v")
    got = {r.finding: r.n for r in copy_diff.diff_copies(left, right, ["k"], ["v"]).groupBy("finding").agg(F.count("*").alias("n")).collect()}
    assert got == {"only_source": 100_000, "only_local": 80_000, "v": sum(i % 9999 == 0 for i in range(100_000, 150_000))}


def test_fields_of_two_types_are_refused(spark):
    a = spark.createDataFrame([(1, 1)], "k INT, v INT")
    with pytest.raises(TypeError):
        copy_diff.diff_copies(a, a.withColumn("v", F.col("v").cast("string")), ["k"], ["v"])


@pytest.mark.parametrize(("text", "want"), [("1650.4300", "1650.43"), (" 12", "12"), ("+7.50", "7.5"), ("50880400E-4", "5088.04"), ("x", None), ("", None), (None, None)])
def test_numbers_in_any_spelling(spark, text, want):
    got = spark.createDataFrame([(text,)], "v STRING").select(copy_diff.numeric_value(F.col("v"))).first()[0]
    assert got == (None if want is None else Decimal(want))


# schema drift


def version(i, table, at, fields, schema="public", catalog="c", large=False):
    data = None
    if fields is not None:
        sink = pa.BufferOutputStream()
        layout = pa.schema([pa.field(n, t, metadata=None if num is None else {"attnum": str(num)}) for num, n, t in fields])
        with pa.ipc.new_file(sink, layout):
            pass
        data = sink.getvalue().to_pybytes()
    return i, catalog, schema, table, dt.datetime(2024, 1, at), f"/d/{i}", data


VERSIONS = "id INT, catalog_name STRING, schema_name STRING, table_name STRING, updated_at TIMESTAMP_NTZ, local_path STRING, arrow_schema BINARY"


def test_schema_steps(spark):
    data = [
        version(1, "t", 1, [(1, "k", pa.int64()), (2, "a", pa.string()), (3, "b", pa.decimal128(10, 2))]),
        version(2, "t", 2, None),
        version(3, "t", 3, [(3, "b", pa.decimal128(12, 2)), (2, "A", pa.large_string()), (1, "k", pa.int64())], schema=None),
        version(4, "t", 4, [(1, "k", pa.int64()), (4, "b", pa.timestamp("us", "UTC"))]),
        version(5, "t", 5, [(4, "b", pa.timestamp("us", "UTC")), (1, "k", pa.int64())]),
        version(6, "u", 1, [(1, "k", pa.int64())]),
    ]
    df = spark.createDataFrame(data + data[:2], VERSIONS)
    found = schema_drift.migration_steps(schema_drift.parse_versions(df)).select("id", "field_name", "change")
    assert rows(found) == sorted([(3, "A", "renamed"), (3, "b", "retyped"), (4, "b", "added"), (4, "A", "removed"), (4, "b", "removed")], key=repr)
    assert schema_drift.migration_steps(schema_drift.parse_versions(df.limit(0))).count() == 0


def test_schema_steps_equal_brute_force(spark, folder):
    table = pq.read_table(f"{folder}/table_arrow_schema.parquet").to_pylist()
    kept = {r["id"]: r for r in table if r["arrow_schema"] is not None}.values()
    want, by = set(), {}
    for r in sorted(kept, key=lambda r: r["updated_at"]):
        key = r["catalog_name"], r["schema_name"] or "public", r["table_name"]
        now = {f.metadata[b"attnum"]: (f.name, str(f.type).replace("large_string", "string")) for f in pa.ipc.open_file(r["arrow_schema"]).schema}
        if (old := by.get(key)) is not None:
            want |= {(r["id"], now[n][0], "added") for n in now.keys() - old.keys()} | {(r["id"], old[n][0], "removed") for n in old.keys() - now.keys()}
            want |= {(r["id"], now[n][0], "renamed") for n in now.keys() & old.keys() if now[n][0] != old[n][0]} | {(r["id"], now[n][0], "retyped") for n in now.keys() & old.keys() if now[n][1] != old[n][1]}
        by[key] = now
    found = schema_drift.migration_steps(schema_drift.parse_versions(spark.read.parquet(f"{folder}/table_arrow_schema.parquet")))
    assert {tuple(r) for r in found.select("id", "field_name", "change").collect()} == want and want


def consistent(spark, versions, content, files=None):
    listed = spark.createDataFrame(files or [(v[0], v[5], "a.parquet") for v in versions], "file_id BIGINT, local_path STRING, file_name STRING")
    parsed = schema_drift.parse_versions(spark.createDataFrame(versions, VERSIONS), bare=True)
    return schema_drift.consistent_rows(parsed, listed, spark.createDataFrame(content, "file_id BIGINT, row_pos INT, row_json STRING"), compaction.directory)


def records(df):
    return {(r.file_id, r.row_pos): None if r.record is None else {f.field: f.value for f in r.record} for r in df.collect()}


def test_rows_come_under_the_newest_schema(spark):
    versions = [version(1, "t", 1, [(1, "k", pa.int64()), (2, "old", pa.string()), (3, "gone", pa.string())]), version(2, "t", 2, [(1, "k", pa.int64()), (2, "new", pa.decimal128(12, 2)), (4, "more", pa.bool_())])]
    content = [(1, 0, '{"k": 5, "old": "7.1", "gone": "x"}'), (1, 1, '{"k": 6, "old": "no number"}'), (2, 0, '{"k": 7, "new": 3, "more": true}'), (2, 0, '{"k": 7, "new": 3, "more": true}'), (3, 0, "{}"), (2, 1, None), (2, 2, "no json"), (2, 3, "[1]")]
    out = consistent(spark, versions, content, [(1, "/d/1/", "a.parquet"), (2, "/d/2", "a.parquet"), (3, "/elsewhere", "a.parquet")])
    assert records(out) == {
        (1, 0): {"k": "5", "new": "7.10", "more": None}, (1, 1): {"k": "6", "new": None, "more": None}, (2, 0): {"k": "7", "new": "3.00", "more": "true"}, (2, 1): {"k": None, "new": None, "more": None}, (2, 2): None, (2, 3): None,
    }
    assert {(r.file_id, r.row_pos, r.raw) for r in out.where("NOT routed").collect()} == {(2, 2, "no json"), (2, 3, "[1]")}
    assert out.limit(0).count() == 0


def test_casts_between_the_versions_act_and_are_noted(spark):
    fields = lambda a, b, c: [(1, "a", a), (2, "b", b), (3, "c", c)]
    versions = [
        version(1, "t", 1, fields(pa.float64(), pa.string(), pa.int64())), version(2, "t", 2, None), version(3, "t", 3, fields(pa.int32(), pa.bool_(), pa.int64())), version(4, "t", 4, [(1, "A", pa.int32()), (2, "b", pa.int16()), (3, "c", pa.int8())]),
        version(5, "t", 5, [(1, "A", pa.float64()), (2, "b", pa.string()), (3, "c", pa.string())]),
    ]
    content = [(1, 0, '{"a": 3.9, "b": "yes", "c": 7}'), (1, 1, '{"a": 3.0, "b": "other", "c": 300}'), (3, 0, '{"a": 4, "b": true, "c": -128}'), (5, 0, '{"A": 3.9, "b": "yes", "c": "300"}'), (2, 0, '{"a": 1.5, "b": "off", "c": 1}')]
    out = consistent(spark, versions, content)
    assert records(out) == {
        (1, 0): {"A": "4.0", "b": "1", "c": "7"}, (1, 1): {"A": "3.0", "b": None, "c": None}, (3, 0): {"A": "4.0", "b": "1", "c": "-128"}, (5, 0): {"A": "3.9", "b": "yes", "c": "300"}, (2, 0): {"A": "2.0", "b": "0", "c": "1"},
    }
    notes = {(r.file_id, r.row_pos): [tuple(n) for n in r.notes] for r in out.collect() if r.notes}
    assert notes == {(1, 0): [("A", "int32", "3.9", "4")], (2, 0): [("A", "int32", "1.5", "2")], (1, 1): [("b", "bool", "other", None), ("c", "int8", "300", None)]}


def test_rows_of_versions_without_schema_are_kept(spark):
    old, new = [(1, "k", pa.int64()), (2, "old", pa.string())], [(1, "k", pa.int64()), (2, "new", pa.string())]
    again = [(1, "k", pa.int64()), (3, "x", pa.string())], [(1, "k", pa.int64()), (4, "x", pa.string())]
    versions = [
        version(1, "t", 1, old), version(2, "t", 2, None), version(3, "t", 3, None), version(4, "t", 4, new), version(5, "t", 5, None),
        version(6, "bare", 1, None), version(7, "u", 1, again[0]), version(8, "u", 2, None), version(9, "u", 3, again[1]),
    ]
    content = [
        (2, 0, '{"k": 1, "old": "a"}'), (2, 1, '{"k": 2, "new": "b"}'), (2, 2, '{"k": 3, "mid": "c"}'), (3, 0, '{"k": 4, "old": "d"}'), (3, 1, '{"new": "e", "k": 5}'),
        (5, 0, '{"k": 6, "new": "f"}'), (5, 1, "{}"), (6, 0, '{"z": 1}'), (8, 0, '{"k": 7, "x": "g"}'), (9, 0, '{"k": 8, "x": "h"}'),
    ]
    out = consistent(spark, versions, content)
    made = records(out)
    got = {(r.file_id, r.row_pos): (made[r.file_id, r.row_pos], r.routed, r.raw) for r in out.collect()}
    want = {(2, 0): {"k": "1", "new": "a"}, (2, 1): {"k": "2", "new": "b"}, (3, 0): {"k": "4", "new": "d"}, (3, 1): {"k": "5", "new": "e"}, (5, 0): {"k": "6", "new": "f"}, (5, 1): {"k": None, "new": None}, (9, 0): {"k": "8", "x": "h"}}
    assert got == {k: (v, True, None) for k, v in want.items()} | {k: (None, False, text) for *k, text in content for k in [tuple(k)] if k not in want}


STEPS = [
    ("true", "int16", "1", False), ("false", "int64", "0", False), ("true", "decimal128(12, 2)", "1.00", False), ("true", "double", "1.0", False), ("true", "string", "true", False), ("true", "bool", "true", False), (" T ", "bool", "true", False),
    ("no", "bool", "false", False), ("0", "bool", "false", False), ("1.0", "bool", "true", False), ("2", "bool", None, False), ("0.5", "bool", None, False), ("abc", "bool", None, False), ("", "bool", None, False), ("x", "int32", None, False), ("true", "date32[day]", None, False),
    ("3.9", "int32", "4", True), ("-2.5", "int32", "-3", True), ("300", "int8", None, False), ("127", "int8", "127", False), ("-1", "uint8", None, False), ("9223372036854775807", "int64", "9223372036854775807", False), ("9223372036854775808", "int64", None, False), ("1e3", "int16", "1000", False),
    ("1234567890123456789012345678.1234567890", "decimal128(38, 10)", "1234567890123456789012345678.1234567890", False), ("12345678901234567890123456789.1", "decimal128(38, 10)", None, False), ("1.005", "decimal128(12, 2)", "1.01", True), ("12345678901.00", "decimal128(12, 2)", None, False),
    ("0.1", "float", "0.1", True), ("0.5", "float", "0.5", False), ("2024-02-29", "date32[day]", "2024-02-29", False), ("2024-02-29T01:02:03", "date32[day]", "2024-02-29", True), ("2024-02-30", "date32[day]", None, False),
    ("2024-02-29T01:02:03.5+02:00", "timestamp[us]", "2024-02-28 23:02:03.5", False), ("2024-02-29T01:02:03Z", "timestamp[us, tz=UTC]", "2024-02-29 01:02:03", False), ("2024-02-29 01:02:03", "timestamp[us]", "2024-02-29 01:02:03", False), ("x", "list<int32>", "x", False),
]


def test_values_under_a_kind(spark):
    row = spark.range(1)
    for i, (value, kind, _, _) in enumerate(STEPS):
        new, other = schema_drift.cast_step(F.lit(value), kind)
        row = row.withColumns({f"n{i}": new, f"o{i}": other})
    got = row.first()
    assert [(v, k, got[f"n{i}"], got[f"o{i}"]) for i, (v, k, _, _) in enumerate(STEPS)] == STEPS


def test_each_table_is_written_with_its_types(spark, tmp_path):
    versions = [
        version(1, "t", 1, [(1, "k", pa.int64()), (2, "a", pa.bool_()), (3, "b", pa.string())]),
        version(2, "t", 2, [(1, "k", pa.int64()), (2, "A", pa.int16()), (3, "file_id", pa.bool_()), (4, "d", pa.decimal128(12, 2)), (5, "at", pa.timestamp("us", "UTC")), (6, "raw", pa.binary()), (7, "day", pa.date32())]),
        version(3, "u", 1, [(1, "x", pa.float64())]),
    ]
    content = [(1, 0, '{"k": 1, "a": true, "b": "f"}'), (2, 0, '{"k": 2, "A": 3, "file_id": true, "d": "1.5", "at": "2024-01-02T03:04:05Z", "raw": "\\\\x00ff", "day": "2024-01-02"}'), (3, 0, '{"x": 0.5}'), (3, 1, "?")]
    made = schema_drift.write_tables(consistent(spark, versions, content), f"file://{tmp_path}/tables")
    made.write.parquet(f"file://{tmp_path}/written")
    found = {r.table_name: r for r in spark.read.parquet(f"file://{tmp_path}/written").groupBy("table_name").agg(F.sum("n_rows").alias("n"), F.max("n_columns").alias("c")).collect()}
    assert (found["t"].n, found["t"].c, found["u"].n, found["u"].c) == (2, 7, 1, 1)
    t = pq.read_table(f"{tmp_path}/tables/c/public/t").sort_by("k")
    assert [str(f.type) for f in t.schema] == ["int64", "int32", "int64", "int16", "bool", "decimal128(12, 2)", "timestamp[us, tz=UTC]", "binary", "date32[day]"]
    assert t.drop(["__file_id", "row_pos"]).to_pylist() == [
        {"k": 1, "A": 1, "file_id": False, "d": None, "at": None, "raw": None, "day": None},
        {"k": 2, "A": 3, "file_id": True, "d": Decimal("1.50"), "at": dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.UTC), "raw": b"\x00\xff", "day": dt.date(2024, 1, 2)},
    ]
    assert pq.read_table(f"{tmp_path}/tables/c/public/u").to_pylist() == [{"file_id": 3, "row_pos": 0, "x": 0.5}]


def test_previous_row_over_ranges(spark):
    rnd = random.Random(3)
    data = [("hot" if i % 3 else rnd.choice(["a", None]), rnd.randrange(10**6), i) for i in range(600)]
    df = spark.createDataFrame(data, "k STRING, o INT, id INT").repartition(5)
    want, last = set(), {}
    for k, o, i in sorted(data, key=lambda r: (repr(r[0]), r[1], r[2])):
        want.add((i, last.get(k)))
        last[k] = i
    assert {(r.id, r.prev_id) for r in with_previous(df, ["k"], ["o", "id"], ["id"]).collect()} == want


def test_previous_row_of_some_over_ranges(spark):
    rnd = random.Random(4)
    data = [("hot" if i % 3 else rnd.choice(["a", None]), rnd.randrange(10**6), i, rnd.random() < 0.2) for i in range(600)]
    df = spark.createDataFrame(data, "k STRING, o INT, id INT, good BOOLEAN").repartition(5)
    want, last = set(), {}
    for k, o, i, good in sorted(data, key=lambda r: (repr(r[0]), r[1], r[2])):
        want.add((i, last.get(k)))
        if good:
            last[k] = i
    assert {(r.id, r.prev_id) for r in with_previous_of(df, ["k"], ["o", "id"], ["id"], F.col("good")).collect()} == want


# snapshots


def test_events_between_snapshots(spark):
    at = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    data = [
        ("t", 1, 1, "a", at[0]), ("t", 1, 2, "b", at[0]), ("t", 1, None, "n", at[0]),
        ("t", 4, 1, "a  ", at[1]), ("t", 4, 3, "c", at[1]), ("t", 4, 3, "old", at[0]),
        ("t", 5, 1, "A", at[2]), ("t", 5, 2, "b", at[2]), ("t", 5, 3, None, at[2]),
        ("t", 9, 1, "A", at[3]), ("t", 9, 2, "b", at[3]), ("t", 9, 3, "", at[3]), ("t", 9, 3, "", at[3]),
        ("u", 1, 1, "a", at[0]),
    ]
    df = spark.createDataFrame(data, "s STRING, n INT, k BIGINT, v STRING, l TIMESTAMP_NTZ")
    found = snapshot_diff.change_events(df, "s", "n", ["k"], [text_value(F.col("v"))], "l")
    want = [("t", 4, 2, "removed"), ("t", 4, 3, "added"), ("t", 5, 1, "changed"), ("t", 5, 2, "added"), ("t", 5, 3, "changed"), ("t", 9, 3, "changed")]
    assert rows(found) == sorted(want, key=repr)
    assert snapshot_diff.change_events(df.limit(0), "s", "n", ["k"], [F.col("v")], "l").count() == 0


# joins on hot keys, and the filter


def test_joins_on_counted_keys_keep_every_row(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) AS h", "id")
    counted = df.groupBy("h").agg(F.count("*").alias("n"))
    old = heavy.SHARE
    heavy.SHARE = 10
    try:
        assert heavy.join_counted(df, counted, "h", 3000).count() == 3000
    finally:
        heavy.SHARE = old
    assert heavy.join_listed(df, counted, "h", 3000, small=1).count() == heavy.join_listed(df, counted, "h", 3000).count() == 3000
    assert heavy.leave_out(df, counted.where("h = 0").select("h"), "h", small=0).count() == 2000


def test_sieve_never_misses(spark):
    keys = spark.range(0, 4000, 2)
    sieve = Sieve.of(keys, "id", 2000)
    at = spark.range(40_000).select("id", key_hash(F.col("id")).alias("h")).toPandas()
    passed = sieve.holds(at["h"].to_numpy())
    assert passed[at["id"].isin(range(0, 4000, 2))].all() and passed.mean() < 0.1
    assert not Sieve.of(keys.limit(0), "id", 0).holds(at["h"].to_numpy()).any()
