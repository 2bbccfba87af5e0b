"""Schemas that drift between versions: fingerprints, migration steps, one consistent table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.adjacent import with_previous, with_previous_of
from millrace.operators.hashing import utc_naive
from millrace.session import stash

FIELDS = "array<struct<attnum:string,name:string,kind:string>>"


def kind_of(t: pa.DataType) -> str:
    """A type's name in which string widths agree and nullability and metadata do not count."""
    if pa.types.is_large_string(t) or pa.types.is_string(t) or str(t) == "string_view":
        return "string"
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        head = str(t).split("<")[0]
        return f"{head}<{kind_of(t.value_type)}>" + (f"[{t.list_size}]" if pa.types.is_fixed_size_list(t) else "")
    if pa.types.is_struct(t):
        return "struct<" + ", ".join(f"{f.name}: {kind_of(f.type)}" for f in t) + ">"
    if pa.types.is_map(t):
        return f"map<{kind_of(t.key_type)}, {kind_of(t.item_type)}>"
    return str(t)


def read_fields(data: bytes) -> list[dict]:
    """Fields of a schema saved as an Arrow IPC file or stream; a field without column number goes by its name."""
    try:
        schema = pa.ipc.open_file(pa.BufferReader(data)).schema
    except pa.ArrowInvalid:
        schema = pa.ipc.open_stream(pa.BufferReader(data)).schema
    return [{"attnum": ((f.metadata or {}).get(b"attnum") or b"name:" + f.name.encode()).decode(), "name": f.name, "kind": kind_of(f.type)} for f in schema]


def parse_versions(versions: DataFrame, bare: bool = False) -> DataFrame:
    """Saved versions with their fields: id, catalog_name, schema_name, table_name, updated_at, local_path, fields, fingerprint.

    Rows without a schema are left out, or with ``bare`` kept with null fields and
    fingerprint; a null schema_name is ``public``, repeated ids count once. The
    fingerprint is a hash of the fields sorted by column number.
    """
    kept = (versions if bare else versions.where("arrow_schema IS NOT NULL")).select("id", "catalog_name", F.coalesce("schema_name", F.lit("public")).alias("schema_name"), "table_name", "updated_at", "local_path", "arrow_schema").dropDuplicates(["id"])
    layout = pa.list_(pa.struct([("attnum", pa.string()), ("name", pa.string()), ("kind", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [None if b is None else read_fields(b) for b in batch.column("arrow_schema").to_pylist()]
            rest = [n for n in batch.schema.names if n != "arrow_schema"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(fields, layout)], names=[*rest, "fields"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "arrow_schema") + f", fields {FIELDS}"
    return kept.mapInArrow(parse, schema).withColumn("fingerprint", F.when(F.col("fields").isNotNull(), F.xxhash64(F.to_json(F.array_sort("fields")))))


KEY = ["catalog_name", "schema_name", "table_name"]


def migration_steps(parsed: DataFrame) -> DataFrame:
    """The steps from each version of a table to the next: id (of the later), prev_id, field_name, change and old and new name and kind.

    ``change`` is added, removed, renamed or retyped; a column both renamed and
    retyped gives two steps. Versions whose fingerprints agree give none. Only
    (key, time, id) is sorted to find predecessors, over ranges, so a table with
    very many versions is no hot task; the fields meet by (version, column number).
    The versions are read several times, so they are parsed once and written.
    """
    parsed = stash(parsed, "versions")
    narrow = parsed.select(*KEY, "updated_at", "id", "fingerprint")
    edges = with_previous(narrow, KEY, ["updated_at", "id"], ["id", "fingerprint"]).where("prev_id IS NOT NULL AND prev_fingerprint <> fingerprint").select("id", "prev_id")
    fields = parsed.select("id", F.explode("fields").alias("f")).select("id", "f.*")
    new = edges.join(fields, "id").select("id", "attnum", F.col("name").alias("new_name"), F.col("kind").alias("new_kind"))
    old = edges.withColumnRenamed("id", "later").join(fields.withColumnRenamed("id", "prev_id"), "prev_id").select(F.col("later").alias("id"), "attnum", F.col("name").alias("old_name"), F.col("kind").alias("old_kind"))
    met = new.join(old, ["id", "attnum"], "full").join(edges, "id")
    changes = F.array_compact(
        F.array(
            F.when(F.col("old_name").isNull(), "added"),
            F.when(F.col("new_name").isNull(), "removed"),
            F.when(F.col("old_name") != F.col("new_name"), "renamed"),
            F.when(F.col("old_kind") != F.col("new_kind"), "retyped"),
        )
    )
    return met.select("id", "prev_id", "attnum", F.coalesce("new_name", "old_name").alias("field_name"), F.explode(changes).alias("change"), "old_name", "new_name", "old_kind", "new_kind")


#: The source's spellings of booleans; 1 and 0 as numbers count too.
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")
INTEGER = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint"}
ZONED = r"(?:[Zz]|[+-]\d\d(?::?\d\d)?)$"


def _number(v: Column) -> Column:
    """Text that may be a boolean, as the text of a number."""
    return F.when(v == "true", "1").when(v == "false", "0").otherwise(F.trim(v))


def cast_step(v: Column, kind: str) -> tuple[Column, Column]:
    """Text under a field kind, in one spelling (null where it does not fit), and whether its value is another one then.

    Numbers are rounded half up to whole ones or to a decimal's scale; of a time under a date the day is left.
    """
    if kind == "bool":
        low, n = F.lower(F.trim(v)), F.trim(v).try_cast("decimal(38,18)")
        return F.when(low.isin(*TRUE) | (n == 1), "true").when(low.isin(*FALSE) | (n == 0), "false"), F.lit(False)
    if kind in INTEGER:
        plain = F.trim(v).try_cast(INTEGER[kind])
        whole = F.coalesce(_number(v).try_cast("decimal(38,0)"), F.round(_number(v).try_cast("double")).try_cast("decimal(38,0)"))
        fits = F.coalesce(plain, whole.try_cast(INTEGER[kind]))
        fits = F.when((fits >= 0) & (fits < 2 ** int(kind[4:])), fits) if kind.startswith("u") else fits
        return fits.cast("string"), plain.isNull() & F.coalesce(_number(v).try_cast("decimal(38,18)") != fits, F.lit(False))
    if found := re.fullmatch(r"decimal\d+\((\d+), (-?\d+)\)", kind):
        precision, scale = map(int, found.groups())
        if not 0 <= scale <= precision <= 38:
            return v, F.lit(False)
        made = _number(v).try_cast(f"decimal({precision},{scale})")
        wide = _number(v).try_cast(f"decimal(38,{38 - max(precision - scale, 1)})")
        return made.cast("string"), F.coalesce(wide != made, F.lit(False))
    if kind in ("halffloat", "float", "double"):
        made = _number(v).try_cast("double" if kind == "double" else "float")
        return made.cast("string"), F.coalesce(made.cast("double") != _number(v).try_cast("double"), F.lit(False))
    if kind.startswith(("date", "timestamp")):
        time = F.when(v.rlike(ZONED) & v.contains(":"), utc_naive(F.trim(v).try_cast("timestamp"))).otherwise(F.trim(v).try_cast("timestamp_ntz"))
        day = time.cast("date")
        return (day.cast("string"), F.coalesce(day.cast("timestamp_ntz") != time, F.lit(False))) if kind.startswith("date") else (time.cast("string"), F.lit(False))
    return v, F.lit(False)


NOTE = "struct<kind:string,old:string,new:string>"


def cast_chain(value: Column, chain: Column, kinds: list[str]) -> Column:
    """A value's text taken through a chain of kinds, one after the other: struct (v, notes: what each step refused or altered)."""

    def under(v: Column, kind: Column) -> Column:
        made = same = F.struct(v.alias("v"), F.lit(False).alias("other"))
        free = [k for k in kinds if k in ("string", "binary")]
        for k in sorted(set(kinds) - set(free), key=lambda k: k in INTEGER):
            new, other = cast_step(v, k)
            made = F.when(kind == k, F.struct(new.alias("v"), other.alias("other"))).otherwise(made)
        return F.when(kind.isin(*free), same).otherwise(made) if free else made

    def step(held: Column, kind: Column) -> Column:
        made = F.transform(F.array(under(held["v"], kind)), lambda m: F.struct(
            m["v"].alias("v"),
            F.concat(held["notes"], F.when(m["other"] | (held["v"].isNotNull() & m["v"].isNull()), F.array(F.struct(kind.alias("kind"), held["v"].alias("old"), m["v"].alias("new")))).otherwise(F.array().cast(f"array<{NOTE}>"))).alias("notes"),
        ))
        return F.when(held["v"].isNull(), held).otherwise(made[0])

    return F.aggregate(chain, F.struct(value.alias("v"), F.array().cast(f"array<{NOTE}>").alias("notes")), step)


LAYOUT = f"struct<at:struct<us:bigint,id:int>,fields:{FIELDS}>"


def version_order() -> Column:
    """By what the versions of a table follow each other."""
    return F.struct(F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(1 << 62))).alias("us"), F.col("id").cast("int").alias("id"))


def layouts_of(parsed: DataFrame) -> DataFrame:
    """Versions with the layouts their records may have (``layouts``: a version's place in order, and its fields) and whether these are only guesses.

    A version with a schema has that one. One without has the schemas of the
    nearest versions of its table with a schema, before and after it.
    """
    order = ["updated_us", "id"]
    narrow = parsed.select(*KEY, F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(1 << 62))).alias("updated_us"), "id", F.col("fields").isNotNull().alias("known"))
    bare = []
    for sign in (1, -1):  # the nearest before; and, with the order turned round, after
        turned = narrow.withColumns({c: F.col(c) * sign for c in order}).withColumn("at", F.col("id") * sign)
        bare.append(with_previous_of(turned, KEY, order, ["at"], F.col("known")).where("NOT known AND prev_at IS NOT NULL").select(F.col("at").alias("id"), F.col("prev_at").alias("near")))
    known = parsed.where("fields IS NOT NULL").withColumn("layout", F.struct(version_order().alias("at"), "fields"))
    near = bare[0].union(bare[1]).join(known.select(F.col("id").alias("near"), "layout"), "near").groupBy("id").agg(F.sort_array(F.collect_list("layout")).alias("layouts"))
    guessed = parsed.where("fields IS NULL").drop("fields").join(near, "id", "left").withColumns({"layouts": F.coalesce("layouts", F.array().cast(f"array<{LAYOUT}>")), "guessed": F.lit(True)})
    return known.withColumn("layouts", F.array("layout")).drop("fields", "layout").withColumn("guessed", F.lit(False)).unionByName(guessed)


def routing_rules(parsed: DataFrame) -> DataFrame:
    """The rule of each version of a table: catalog_name, schema_name, table_name, version order ``at``, local_path, ``guessed`` and ``ways`` to read a record.

    The retyping steps of ``migration_steps`` are chained: a way gives, for each newest column, its name in the record (by column
    number, through all renames; null, the default, if it was added later) and the kinds that its value goes through, from the version's to the newest.
    """
    retyped = migration_steps(parsed.where("fields IS NOT NULL")).where("change = 'retyped'").select("id", "attnum", F.col("new_kind").alias("kind"))
    placed = retyped.join(parsed.select("id", *KEY, version_order().alias("at")), "id")
    history = placed.groupBy(*KEY, "attnum").agg(F.sort_array(F.collect_list(F.struct("at", "kind"))).alias("steps")).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("attnum", "steps"))).alias("history"))
    newest = parsed.where("fields IS NOT NULL").groupBy(*KEY).agg(F.max_by("fields", version_order()).alias("target")).join(history, KEY, "left")

    def column(layout: Column, t: Column) -> Column:
        mine = F.filter(layout["fields"], lambda f: f["attnum"] == t["attnum"])[0]
        steps = F.coalesce(F.filter(F.element_at(F.col("history"), t["attnum"]), lambda h: h["at"] > layout["at"]), F.array().cast("array<struct<at:struct<us:bigint,id:int>,kind:string>>"))
        chain = F.when(mine.isNotNull(), F.concat(F.array(mine["kind"]), F.transform(steps, lambda h: h["kind"])))
        return F.struct(t["name"].alias("field"), t["kind"].alias("kind"), mine["name"].alias("source"), chain.alias("chain"))

    ways = F.transform("layouts", lambda x: F.struct(F.array_sort(F.transform(x["fields"], lambda f: f["name"])).alias("names"), F.transform(F.coalesce("target", F.array().cast(FIELDS)), lambda t: column(x, t)).alias("columns")))
    return layouts_of(parsed).join(newest, KEY, "left").select(*KEY, version_order().alias("at"), "local_path", "guessed", ways.alias("ways"))


def consistent_rows(parsed: DataFrame, files: DataFrame, rows: DataFrame, directory: Callable[[Column], Column]) -> DataFrame:
    """All rows of the snapshot files under the newest schema of their table.

    A file goes by the rule of its directory's version (the newest with a schema, where several name it): each value is cast step by step
    along the versions, so what an intermediate type loses stays lost, and every value that a step refused (null then) or
    altered is in ``notes``; columns that the version lacks are null, removed ones go. Result: the table's key, file_id, row_pos, ``record``, the newest columns in order
    (field, kind, value as text in one spelling per kind), ``notes`` (field, kind of the step, old and new text), ``routed`` and ``raw``.

    ``parsed`` should hold the versions without a schema too. A record of such a
    version goes by the nearest version with a schema, before it or else after it, that has
    exactly the record's names. If neither has, or both have and give the
    columns different numbers, or no version of the table has a schema, or the record is no JSON object, it is not
    ``routed``: ``record`` is null and ``raw`` holds its JSON as it stands. A null record is an empty one.

    A file whose directory no version names is left out. Repeated files and rows
    count once. Rows are shuffled once, by file; all casts run in the JVM. The kinds that occur, as many as
    there are types, are listed on the driver.
    """
    parsed = stash(parsed, "versions")
    kinds = sorted(r[0] for r in parsed.select(F.explode("fields.kind").alias("kind")).distinct().collect())
    latest = F.struct(~F.col("guessed"), "at")
    rules = routing_rules(parsed).groupBy(directory(F.col("local_path")).alias("directory"), *KEY).agg(F.max_by(F.struct("ways", "guessed"), latest).alias("rule"))
    listed = files.select("file_id", directory(F.col("local_path")).alias("directory")).dropDuplicates(["file_id"])
    ruled = listed.join(rules, "directory").select(*KEY, "file_id", "rule.ways", "rule.guessed")
    once = rows.select("file_id", "row_pos", "row_json").repartition("file_id").dropDuplicates(["file_id", "row_pos"])
    read = once.join(ruled, "file_id").withColumn("values", F.try_variant_get(F.try_parse_json(F.coalesce("row_json", F.lit("{}"))), "$", "map<string,string>"))
    names = F.array_sort(F.map_keys("values"))
    fits = F.when(F.col("guessed"), F.filter("ways", lambda w: (F.size("values") == 0) | (w["names"] == names))).otherwise(F.col("ways"))
    told = (F.size("fits") > 0) & ((F.size("values") == 0) | (F.size(F.array_distinct(F.transform("fits", lambda w: F.transform(w["columns"], lambda c: F.struct(c["field"], c["source"]))))) == 1))
    chosen = read.withColumn("fits", F.when(F.col("values").isNotNull(), fits)).withColumn("columns", F.when(told, F.col("fits")[0]["columns"]))
    made = F.transform("columns", lambda c: F.struct(c["field"].alias("field"), c["kind"].alias("kind"), cast_chain(F.element_at(F.col("values"), c["source"]), F.coalesce(c["chain"], F.array().cast("array<string>")), kinds).alias("x")))
    cast = chosen.withColumn("made", made)
    notes = F.flatten(F.transform("made", lambda c: F.transform(c["x"]["notes"], lambda n: F.struct(c["field"].alias("field"), n["kind"].alias("kind"), n["old"].alias("old"), n["new"].alias("new")))))
    record = F.transform("made", lambda c: F.struct(c["field"].alias("field"), c["kind"].alias("kind"), c["x"]["v"].alias("value")))
    routed = F.col("columns").isNotNull()
    return cast.select(*KEY, "file_id", "row_pos", record.alias("record"), F.coalesce(notes, F.array().cast("array<struct<field:string,kind:string,old:string,new:string>>")).alias("notes"), routed.alias("routed"), F.when(~routed, F.coalesce("row_json", F.lit("{}"))).alias("raw"))


def arrow_type(kind: str) -> pa.DataType:
    """The type of a typed column; text for what has no plain value."""
    if found := re.fullmatch(r"decimal\d+\((\d+), (-?\d+)\)", kind):
        return pa.decimal128(*map(int, found.groups())) if int(found[1]) <= 38 else pa.string()
    plain = {"bool": pa.bool_(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary(), "date32[day]": pa.date32(), "date64[ms]": pa.date32()} | {f"{u}int{n}": getattr(pa, f"{u}int{n}")() for u in ("", "u") for n in (8, 16, 32, 64)}
    if kind.startswith("timestamp"):
        return pa.timestamp("us", "UTC" if "tz=" in kind else None)
    return plain.get(kind, pa.string())


def _typed(texts: pa.Array, kind: str) -> pa.Array:
    to = arrow_type(kind)
    if pa.types.is_binary(to):
        return pa.array([None if t is None else bytes.fromhex(t[2:]) if re.fullmatch(r"\\x(?:[0-9a-fA-F]{2})*", t) else t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()], to)
    if pa.types.is_timestamp(to):
        return texts.cast(pa.timestamp("us")).cast(pa.int64()).cast(to)
    return texts.cast(to)


def write_tables(routed: DataFrame, out: str) -> DataFrame:
    """Write the routed rows of ``consistent_rows`` as one typed parquet table for each source table: a folder below ``out`` each.

    Rows are ranged by (table, file), so a large table is written by many tasks, each one its file, in row groups of a batch. Columns
    are file_id, row_pos and the newest columns, typed as in the newest schema (file_id and row_pos are the record's origin, renamed if the table has such columns). ``out`` is the URI of a shared folder.
    Result: a row per written file: the table's key, path, n_rows, n_columns. Evaluating it writes: write it down once.
    """
    ranged = routed.where("routed").select(*KEY, "file_id", "row_pos", "record").repartitionByRange(*KEY, "file_id").sortWithinPartitions(*KEY, "file_id", "row_pos")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(out)
        at, writer, path, n, width = None, None, None, 0, 0

        def close() -> pa.RecordBatch:
            writer.close()
            fs.move(path + ".part", path)
            return pa.RecordBatch.from_pydict({**{k: pa.array([v], pa.string()) for k, v in zip(KEY, at, strict=True)}, "path": [path], "n_rows": pa.array([n], pa.int64()), "n_columns": pa.array([width], pa.int32())})

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                fields = part.column(5).flatten()
                each = len(fields) // part.num_rows
                names, types, texts = fields.flatten()
                names, types = names.slice(0, each).to_pylist(), types.slice(0, each).to_pylist()
                columns = [_typed(texts.take(pa.array(range(i, len(texts), each))), kind) for i, kind in enumerate(types)]
                own = [c if c not in names else f"__{c}" for c in ("file_id", "row_pos")]
                table = pa.Table.from_arrays([part.column(3), part.column(4), *columns], names=[*own, *names])
                if keys[start] != at:
                    if writer:
                        yield close()
                    at, n, width = keys[start], 0, each
                    home = "/".join([folder, *(re.sub(r"[^\w.-]", "_", k or "null") for k in at)])
                    fs.create_dir(home)
                    path = f"{home}/{uuid.uuid4().hex}.parquet"
                    writer = pq.ParquetWriter(path + ".part", table.schema, filesystem=fs, compression="zstd")
                writer.write_table(table)
                n += end - start
        if writer:
            yield close()

    return ranged.mapInArrow(write, "catalog_name string, schema_name string, table_name string, path string, n_rows bigint, n_columns int")
