"""Queries of the text corpus problems, over whole tables and whole texts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import leakage, sharing, tokens
from millrace.sources.tables import load

#: Where the vocabulary files of the public tokenizers are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p6_ids(spark: SparkSession, folder: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(load(spark, folder, "documents"), vocabulary)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items of which they hold 80 consecutive reduced characters."""
    return leakage.find_leaks(load(spark, folder, "documents"), load(spark, folder, "eval_item"), span=80, edits=0).select("doc_id", "item_id")


def p7_edits(spark: SparkSession, folder: str) -> DataFrame:
    """As p7_found, with up to four edits in the 80 characters, and how many were needed."""
    return leakage.find_leaks(load(spark, folder, "documents"), load(spark, folder, "eval_item"), span=80, edits=4)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of each document made of stretches of 400 code points that another document holds too."""
    return sharing.shared_spans(load(spark, folder, "documents"), span=400)


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p7_edits": p7_edits, "p8_found": p8_found}
#: p6_ids and p7_found have no SQL twins: the tests hold them against a public encoder and brute force.
ORACLES: dict[str, str] = {
    "p8_found": """
        WITH w AS (SELECT doc_id, s, hash(substr(text, s + 1, 400)) AS a, md5_number_lower(substr(text, s + 1, 400)) AS b
                   FROM (SELECT doc_id, text, unnest(range(length(text) - 399)) AS s FROM documents WHERE length(text) >= 400)),
        held AS (SELECT a, b FROM w GROUP BY a, b HAVING min(doc_id) <> max(doc_id)),
        m AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN held USING (a, b)),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM m)
        SELECT doc_id, min(s)::INT AS span_start, (max(s) + 400)::INT AS span_end FROM g GROUP BY doc_id, island""",
}
