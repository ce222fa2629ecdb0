"""Queries of the text problems 6 to 8, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import abuse as A
from tidegauge.llm import mix as M
from tidegauge.llm import pack as P
from tidegauge.llm.tokens import document_sizes
from tidegauge.sources.tables import table


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return P.pack_documents(document_sizes(table(spark, d, "documents")), table(spark, d, "pack_target"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return P.cut_documents(_packed(spark, d))


def p6_room(spark: SparkSession, d: str) -> DataFrame:
    return P.room_report(_packed(spark, d))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return M.mix_report(*M.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_target")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return M.short_sources(_mixed(spark, d))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return M.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_target"))[0].filter("repeats > 0").select(
        "doc_id", "tokens", "repeats"
    )


def _scored(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    model = A.train(A.labelled_rows(table(spark, d, "content_label")))
    return A.score_documents(table(spark, d, "documents"), model, keep)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return A.harmful_documents(_scored(spark, d))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return A.rates_by_source(_scored(spark, d, "source"))


QUERIES = {
    f.__name__: f
    for f in (p6_found, p6_room, p6_assignment, p7_found, p7_shares, p7_selection, p8_found, p8_scores, p8_rates)
}

_TOKENS = r"""
WITH t AS (SELECT doc_id, lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) AS source,
    len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]+')) AS n FROM documents)
"""

ORACLE_SQL = {
    "p6_found": _TOKENS + "SELECT DISTINCT container, doc_id FROM t JOIN pack_target ON n > capacity",
    "p7_found": _TOKENS
    + """, s AS (SELECT m.source, m.weight, m.max_repeat, coalesce(sum(t.n), 0) AS n FROM mix_target m LEFT JOIN t ON t.source = m.source GROUP BY ALL)
       SELECT source FROM s WHERE n * max_repeat < weight * (SELECT sum(n) FROM s)""",
}
