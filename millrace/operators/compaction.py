"""Many small files into few well-sized ones: balanced plan, streamed write, verified manifest."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import stash

SMALL_FILE = 1 << 20
TARGET_FILE = 128 << 20
#: Files that one heap packs into bundles, about, and bundles that it makes at most.
FILES_PER_SLICE, BUNDLES_PER_SLICE = 65_536, 1024
#: Characters of a row group in a written file, about.
ROW_GROUP = 32 << 20


def directory(path: Column) -> Column:
    """One spelling per directory: no ``file:`` prefix, ``.`` steps, repeated or final slashes."""
    bare = F.regexp_replace(path, r"^file:(//)?", "")
    single = F.regexp_replace(bare, r"/+", "/")
    steps = F.regexp_replace(F.regexp_replace(single, r"(/\.)+(/|$)", "$2"), r"^(\./)+", "")
    return F.regexp_replace(steps, r"/+$", "")


def is_data_file(name: Column) -> Column:
    """Whether a listed name is a data file."""
    return name.endswith(".parquet") & ~name.startswith("_") & ~name.startswith(".")


def current_directories(versions: DataFrame) -> DataFrame:
    """The directory of each table's newest version (``directory``), each once."""
    key = ["catalog_name", F.coalesce("schema_name", F.lit("public")).alias("schema_name"), "table_name"]
    newest = versions.groupBy(*key).agg(F.max(F.struct("updated_at", "id", "local_path")).alias("newest"))
    return newest.select(directory(F.col("newest.local_path")).alias("directory")).where("directory IS NOT NULL").distinct()


def small_files(listing: DataFrame, current: DataFrame, small: int = SMALL_FILE) -> DataFrame:
    """Small data files of the current directories that hold at least two of them.

    Columns directory, file_id, size_bytes, row_count, siblings. Repeated listing
    rows count once; a null name or size is no case; a null row_count is kept.
    """
    files = (
        listing.where(is_data_file(F.col("file_name")) & (F.col("size_bytes") < small))
        .select(directory(F.col("local_path")).alias("directory"), "file_id", "size_bytes", "row_count")
        .dropDuplicates(["file_id"])
        .join(current, "directory", "left_semi")
    )
    counts = files.groupBy("directory").agg(F.count("*").alias("siblings")).where("siblings > 1")
    return files.join(counts, "directory")


def schedule(sizes: list[int], groups: int) -> list[int]:
    """Longest first (ties in the order given) onto the least loaded of ``groups`` groups: the group of each size."""
    heap, placed = [(0, g) for g in range(groups)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, placed[i] = heap[0]
        heapq.heapreplace(heap, (load + max(sizes[i], 1), placed[i]))
    return placed


def plan(files: DataFrame, target: int = TARGET_FILE, per_slice: int = FILES_PER_SLICE, bundles: int = BUNDLES_PER_SLICE) -> DataFrame:
    """Assign each file of ``small_files`` to an output group: directory, output_group, file_id.

    Each directory gets ceil(bytes / target) groups. Two levels of heaps: the files
    of a directory, in slices of about ``per_slice`` by a hash of the file id, go longest first to the least loaded of at
    most ``bundles`` bundles of their slice (so up to that many files are each a bundle); then all bundles of the
    directory go longest first to the least loaded of its groups. No task holds more than a slice or a
    directory's bundles, and the loads of a directory's groups differ by at most its largest bundle.
    """
    slices = F.greatest(F.lit(1), F.ceil(F.col("siblings") / F.lit(per_slice))).cast("int")
    sliced = files.select("directory", F.pmod(F.xxhash64("file_id"), slices).cast("int").alias("slice"), "file_id", "size_bytes")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("file_id")
        sizes = table["size_bytes"].to_pylist()
        placed = schedule(sizes, min(bundles, len(sizes)))
        loads = np.bincount(placed, weights=np.maximum(sizes, 1)).astype(np.int64)
        return table.select(["directory", "slice", "file_id"]).append_column("bundle", pa.array(placed, pa.int32())).append_column("load", pa.array(loads[placed])).append_column("bytes", table["size_bytes"])

    def assign(table: pa.Table) -> pa.Table:
        table = table.sort_by([("slice", "ascending"), ("bundle", "ascending")])
        groups = max(1, -(-pc.sum(table["bytes"]).as_py() // target))
        return table.select(["directory", "slice", "bundle"]).append_column("output_group", pa.array(schedule(table["load"].to_pylist(), groups), pa.int32()))

    packed = stash(sliced.groupBy("directory", "slice").applyInArrow(pack, "directory string, slice int, file_id bigint, bundle int, load bigint, bytes bigint"), "bundles")
    loads = packed.groupBy("directory", "slice", "bundle").agg(F.first("load").alias("load"), F.sum("bytes").alias("bytes"))
    grouped = loads.groupBy("directory").applyInArrow(assign, "directory string, slice int, bundle int, output_group int")
    return packed.join(grouped, ["directory", "slice", "bundle"]).select("directory", "output_group", "file_id")


def record_mark() -> Column:
    """A checksum of a record's file, position and content, by which those written are held against those read."""
    content = F.coalesce(F.col("row_json").cast("binary"), F.unhex(F.lit("00")))
    return F.crc32(F.concat(F.concat_ws("/", "file_id", "row_pos", F.lit("")).cast("binary"), content))


def contents(rows: DataFrame) -> DataFrame:
    """Of each file that has records: file_id, n_rows, checksum and whether two records claim one position. Repeated records count once."""
    once = rows.select("file_id", "row_pos", record_mark().alias("mark")).distinct()
    once = once.groupBy("file_id", "row_pos").agg(F.sum("mark").alias("mark"), F.count("*").alias("twice"))
    return once.groupBy("file_id").agg(F.count("*").alias("n_rows"), F.sum("mark").alias("checksum"), (F.max("twice") > 1).alias("clash"))


def held_against(files: DataFrame, content: DataFrame, readable: int) -> DataFrame:
    """The files of ``small_files`` with what their content has (n_rows, checksum) and why they are ``refused``, null if they are not.

    The listing, not the content, says what must be there: a file is refused if it is of ``readable``
    bytes or more (its content is not at hand), if it holds other than the listed number of records, or two records at one
    position. A file of unknown count holds what its content has.
    """
    met = files.join(content, "file_id", "left").withColumns({"n_rows": F.coalesce("n_rows", F.lit(0).cast("bigint")), "checksum": F.coalesce("checksum", F.lit(0).cast("bigint"))})
    why = F.when(F.col("size_bytes") >= readable, "not readable").when(F.col("clash"), "two records at one position").when(F.col("row_count") != F.col("n_rows"), "other count than listed")
    return met.withColumn("refused", why).drop("clash")


WRITTEN = pa.schema([("directory", pa.string()), ("output_group", pa.int32()), ("output_path", pa.string()), ("n_files", pa.int64()), ("n_rows", pa.int64()), ("n_bytes", pa.int64())])


def write_groups(assigned: DataFrame, rows: DataFrame, out: str) -> DataFrame:
    """Stream each output group's records through pyarrow into one parquet file.

    ``rows`` (file_id, row_pos, row_json) is the content of the small files;
    repeated rows count once. Records arrive sorted by group, file and position
    and are written in row groups of about ROW_GROUP characters, so a task holds one row group, not a file.
    A file is written under a temporary name and renamed; ``out`` is the URI of a
    folder that all executors share (file:, hdfs:, s3: and what else pyarrow knows). Result: a row for each file written.
    """
    content = rows.join(assigned, "file_id").dropDuplicates(["file_id", "row_pos"])
    group = ["directory", "output_group"]
    ordered = content.select(*group, "file_id", "row_pos", "row_json").repartition(*group).sortWithinPartitions(*group, "file_id", "row_pos")
    layout = pa.schema([("file_id", pa.int64()), ("row_pos", pa.int32()), ("row_json", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(out)
        fs.create_dir(folder)
        at, writer, said, held, size, last = None, None, None, [], 0, None

        def flush() -> None:
            nonlocal held, size
            if held:
                writer.write_table(pa.Table.from_batches(held))
            held, size = [], 0

        def close() -> pa.RecordBatch:
            flush()
            writer.close()
            fs.move(said["output_path"] + ".part", said["output_path"])
            return pa.RecordBatch.from_pylist([said | {"n_bytes": fs.get_file_info(said["output_path"]).size}], schema=WRITTEN)

        for batch in batches:
            names, groups, ids = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            change = (groups[1:] != groups[:-1]) | pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                here = names[start].as_py(), int(groups[start])
                if here != at:
                    if writer:
                        yield close()
                    at, last = here, None
                    path = f"{folder}/{uuid.uuid4().hex}.parquet"
                    writer = pq.ParquetWriter(path + ".part", layout, filesystem=fs, compression="zstd")
                    said = {"directory": at[0], "output_group": at[1], "output_path": path, "n_files": 0, "n_rows": 0}
                part = ids[start:end]
                said["n_files"] += int((part[1:] != part[:-1]).sum()) + int(part[0] != last)
                said["n_rows"] += end - start
                last = part[-1]
                held.append(batch.select(["file_id", "row_pos", "row_json"]).slice(start, end - start).cast(layout))
                size += held[-1].nbytes
                if size >= ROW_GROUP:
                    flush()
        if writer:
            yield close()

    return ordered.mapInArrow(write, "directory string, output_group int, output_path string, n_files bigint, n_rows bigint, n_bytes bigint")


def publish(written: DataFrame, assigned: DataFrame, checked: DataFrame, manifest: str) -> DataFrame:
    """Verify the written files against the listing and publish the manifest at once.

    ``written`` must be materialised (its evaluation writes files). The files are read again, and of every
    group that ``assigned`` plans, the number of source files that hold records, of records, and their checksum must be those that
    ``checked`` (the result of ``held_against``) gives, else RuntimeError and nothing becomes
    visible; so does a planned file that is not in ``checked`` or refused there. The manifest is written aside and renamed; the files refused are listed in ``manifest``-refused before.
    """
    spark = written.sparkSession
    on = ["directory", "output_group"]
    want = assigned.join(checked.drop("directory"), "file_id", "left").groupBy(*on).agg(
        F.count_if(F.expr("n_rows > 0")).alias("want_files"), F.sum("n_rows").alias("want_rows"), F.sum("checksum").alias("want_checksum"), F.count_if(F.expr("n_rows IS NULL OR refused IS NOT NULL")).alias("unknown")
    )
    paths = written.select("output_path").where("n_rows > 0")
    listed = [r[0] for r in paths.limit(1).collect()]
    folder = listed[0].rsplit("/", 1)[0] if listed else None
    if folder:
        read = spark.read.schema("file_id bigint, row_pos int, row_json string").parquet(folder).select("file_id", F.col("_metadata.file_name").alias("name"), record_mark().alias("mark"))
        per_source = read.groupBy("name", "file_id").agg(F.count("*").alias("n"), F.sum("mark").alias("m"))
        got = per_source.groupBy("name").agg(F.count("*").alias("got_files"), F.sum("n").alias("got_rows"), F.sum("m").alias("got_checksum"))
        made = written.withColumn("name", F.element_at(F.split("output_path", "/"), -1)).join(got, "name", "left").select(*on, "got_files", "got_rows", "got_checksum")
    else:
        made = written.select(*on, F.lit(0).alias("got_files"), F.lit(0).alias("got_rows"), F.lit(0).alias("got_checksum"))
    same = F.lit(True)
    for what in ("files", "rows", "checksum"):
        same &= F.coalesce(f"got_{what}", F.lit(0)) == F.coalesce(f"want_{what}", F.lit(0))
    bad = made.join(want, on, "full").where(~same | (F.coalesce("unknown", F.lit(1)) > 0)).count()
    if bad:
        raise RuntimeError(f"{bad} output groups differ from their input; nothing was published")
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, aside = hadoop.Path(manifest), hadoop.Path(f"{manifest}.pending-{uuid.uuid4().hex}")
    written.write.parquet(aside.toString())
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(final):
        checked.where("refused IS NOT NULL").write.mode("overwrite").parquet(f"{manifest}-refused")
    if fs.exists(final) or not fs.rename(aside, final):
        raise RuntimeError(f"{manifest} was published by another run")
    return spark.read.parquet(manifest)
