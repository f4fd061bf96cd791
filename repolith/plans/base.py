"""Registration of queries, and the carrier views over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as functions; quality 1 is visible."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("signature"), F.concat("source", F.lit(".c")).alias("filename"),
        F.coalesce("text", F.lit("")).alias("code"), "lang", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("visible"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PRIVATE_STATIC' WHEN 2 THEN 'PROTECTED' ELSE 'PUBLIC_ASYNC_UNSAFE' END").alias("modifier"), "n_chars",
    )


FUNCTIONS = """fn AS (SELECT d.doc_id AS ord, 'doc_' || d.doc_id AS signature, d.source || '.c' AS filename, COALESCE(d.text, '') AS code, d.lang, COALESCE(l.quality = 1, FALSE) AS visible,
  CASE d.doc_id % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PRIVATE_STATIC' WHEN 2 THEN 'PROTECTED' ELSE 'PUBLIC_ASYNC_UNSAFE' END AS modifier, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id))"""


def part_calls(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (src, dst): a part calls the next part of its order. The graph is one large cyclic core."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst IS NOT NULL AND src <> dst").distinct()


PART_CALLS = """lead_ AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem),
ce AS (SELECT DISTINCT src, dst FROM lead_ WHERE dst IS NOT NULL AND src <> dst)"""


def dag(spark: SparkSession, d: str) -> DataFrame:
    return part_calls(spark, d).where("src > dst")


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (src, dst) event types that follow each other; small, dense, with loops."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return rows.where("dst IS NOT NULL").distinct()


TRANSITIONS = """step AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
tr AS (SELECT DISTINCT src, dst FROM step WHERE dst IS NOT NULL)"""


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as Markdown documents: a block per turn, with a section for its text."""
    turn = F.concat(F.lit("### "), F.col("role"), F.lit(" "), F.col("turn"), F.lit("\n#### Description\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "[#\n]+", " "), F.lit("\n#### Parameters\n- first\n- "), F.col("role"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", turn.alias("block"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n").alias("text"))


MARKDOWN = """md_turn AS (SELECT conv_id, turn, role, '### ' || role || ' ' || turn || chr(10) || '#### Description' || chr(10) || regexp_replace(COALESCE(text, ''), '[#\\n]+', ' ', 'g') || chr(10) || '#### Parameters' || chr(10) || '- first' || chr(10) || '- ' || role AS block FROM conversations),
md AS (SELECT conv_id, string_agg(block, chr(10) ORDER BY turn, block) AS text FROM md_turn GROUP BY conv_id)"""
