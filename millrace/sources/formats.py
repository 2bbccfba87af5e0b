"""Reading and writing file formats, with checked options."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

# The option names that each format accepts, in lower case.
OPTIONS = {
    "csv": "sep delimiter encoding charset quote escape comment header inferschema ignoreleadingwhitespace ignoretrailingwhitespace nullvalue nanvalue positiveinf negativeinf dateformat timestampformat timestampntzformat maxcolumns maxcharspercolumn mode columnnameofcorruptrecord multiline lineSep compression quoteall escapequotes emptyvalue samplingratio enforceschema locale unescapedquotehandling chartoescapequoteescaping timezone preferdate".lower().split(),
    "json": "timezone primitivesasstring prefersdecimal allowcomments allowunquotedfieldnames allowsinglequotes allownumericleadingzeros allowbackslashescapinganycharacter mode columnnameofcorruptrecord dateformat timestampformat timestampntzformat multiline allowunquotedcontrolchars encoding linesep samplingratio dropfieldifallnull locale allownonnumericnumbers compression ignorenullfields".split(),
    "parquet": "compression mergeschema datetimerebasemode int96rebasemode parquet.block.size parquet.page.size parquet.enable.dictionary parquet.bloom.filter.enabled".split(),
    "text": "wholetext linesep compression".split(),
    "orc": "compression mergeschema".split(),
    "avro": "compression avroschema recordname recordnamespace mode".split(),
    "arrow": [],
}
COMMON = "path pathglobfilter recursivefilelookup modifiedbefore modifiedafter ignorecorruptfiles ignoremissingfiles basepath maxrecordsperfile".split()


def checked(fmt: str, options: dict) -> dict:
    """The options, after a check that the format knows their names."""
    fmt = fmt.lower()
    if fmt not in OPTIONS:
        raise ValueError(f"unknown format {fmt}")
    allowed = {*OPTIONS[fmt], *COMMON}
    if unknown := [o for o in options if o.lower() not in allowed and not o.lower().startswith("parquet.")]:
        raise ValueError(f"unknown options for {fmt}: {sorted(unknown)}")
    if fmt == "avro" and not _has_avro():
        raise NotImplementedError("the spark-avro jar is not on the class path")
    return options


def _has_avro() -> bool:
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource("avro", spark._jsparkSession.sessionState().conf())
        return True
    except Exception:  # noqa: BLE001
        return False


def read(spark: SparkSession, fmt: str, paths: str | list[str], schema=None, **options) -> DataFrame:
    """Read files; paths may be globs."""
    options = checked(fmt, options)
    if fmt.lower() == "arrow":
        return read_arrow(spark, paths if isinstance(paths, list) else [paths])
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(paths)


def write(df: DataFrame, fmt: str, path: str, mode: str = "errorifexists", partition_by: Iterable[str] = (), **options) -> None:
    """Write files under a save mode."""
    options = checked(fmt, options)
    if fmt.lower() == "arrow":
        return write_arrow(df, path, mode)
    df.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def _uri(path: str) -> str:
    """A location as a URI that pyarrow knows; a bare path is a local one."""
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def _located(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(_uri(path).replace("file:///", "file:/").replace("file:/", "file:///"))


def _arrow_files(path: str) -> list[str]:
    """URIs of the Arrow files at a location, a file or a folder."""
    fs, at = _located(path)
    head = _uri(path)[: len(_uri(path).rstrip("/")) - len(at.rstrip("/"))]
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.File:
        return [head + at]
    found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted(head + f.path for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", ".")) and not f.base_name.endswith(".part"))


def read_arrow(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow IPC files of any file system that pyarrow knows (file:, hdfs:, s3: ...): the driver lists them, tasks read their schemas and then the files batch by batch.

    The columns of all files come out, null where a file lacks them. Files that give a column different types are refused.
    """
    files = [f for p in paths for f in _arrow_files(p)]
    if not files:
        raise FileNotFoundError(f"no Arrow files in {', '.join(paths)}")
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 10_000)))

    def opened(uri: str, schema: pa.Schema | None = None) -> ds.Dataset:
        fs, at = pa.fs.FileSystem.from_uri(uri)
        return ds.dataset([at], format="arrow", filesystem=fs, schema=schema)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(0).to_pylist()
            found = [opened(f).schema.remove_metadata().serialize().to_pybytes() for f in files]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(files, pa.string())], names=["footer", "file"])

    kinds = listed.mapInArrow(footers, "footer binary, file string").groupBy("footer").agg(F.min("file").alias("file")).orderBy("file").collect()
    schema = pa.unify_schemas([pa.ipc.read_schema(pa.py_buffer(bytes(r.footer))) for r in kinds])
    target = from_arrow_schema(schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0).to_pylist():
                yield from opened(f, schema).to_batches(batch_size=65_536)

    return listed.mapInArrow(load, target)


def write_arrow(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each partition to its Arrow IPC file in a folder that all tasks share, on any file system that pyarrow knows; files appear under their names when they are whole."""
    fs, folder = _located(path)
    if fs.get_file_info(folder).type != pa.fs.FileType.NotFound:
        if mode == "ignore":
            return
        if mode in ("errorifexists", "error"):
            raise FileExistsError(path)
        if mode == "overwrite":
            fs.delete_dir(folder)
    fs.create_dir(folder)
    uri = _uri(path)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _located(uri)
        name, writer, out, n = f"{folder}/{uuid.uuid4().hex}.arrow", None, None, 0
        for batch in batches:
            if writer is None:
                out = fs.open_output_stream(name + ".part")
                writer = pa.ipc.new_file(out, batch.schema)
            writer.write_batch(batch)
            n += batch.num_rows
        if writer:
            writer.close()
            out.close()
            fs.move(name + ".part", name)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    df.mapInArrow(save, "n bigint").agg(F.sum("n")).collect()
