"""A query per category of scalar functions: a column for each function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.catalogue import CATALOGUE, SAME
from millrace.functions.extras import install
from millrace.sources.tables import load


_INT = """array_size shuffle cardinality size date_part datepart day dayofmonth dayofweek dayofyear extract hour minute month quarter second weekday weekofyear year filter
    bit_length char_length character_length instr len length levenshtein locate octet_length position regexp_count regexp_instr strpos bit_count""".split()
#: Type of the twin's column where the engines' integer widths differ.
TYPES = dict.fromkeys(_INT, "INTEGER") | dict.fromkeys(["array_position", "zeroifnull", "crc32", "bitmap_count"], "BIGINT") | {"sequence": "INTEGER[]", "bit_get": "TINYINT", "getbit": "TINYINT", "months_between": "DOUBLE"}


def _query(category: str):
    table, key, entries = CATALOGUE[category]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        install(spark)
        return load(spark, folder, table).selectExpr(key, *[f"{spark_text} AS `fn_{name}`" for name, spark_text, _ in entries])

    run.__name__ = f"fn_{category}"
    run.__doc__ = f"The {category} functions over {table}."
    return run


def _typed(name: str, text: str) -> str:
    return f"CAST({text} AS {TYPES[name]})" if name in TYPES else text


def _oracle(category: str) -> str:
    table, key, entries = CATALOGUE[category]
    columns = ", ".join(_typed(name, text if twin == SAME else twin) + f" AS fn_{name}" for name, text, twin in entries)
    return f"SELECT {key}, {columns} FROM {table}"


QUERIES = {f"fn_{c}": _query(c) for c in CATALOGUE}
ORACLES = {f"fn_{c}": _oracle(c) for c in CATALOGUE}
