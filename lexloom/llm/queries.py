"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import fold_column, table


def _with_fold(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", F.coalesce(fold_column(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return _with_fold(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), toxicity.THRESHOLD)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm import line_dedup

    return line_dedup.report(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm import exact_dedup

    return exact_dedup.report(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm import substring_dedup

    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm import quality

    docs = table(spark, sf_dir, "documents")
    return _with_fold(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))), quality.THRESHOLD)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm import media

    return media.columns(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm import mixing

    return mixing.totals(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm import simhash

    return simhash.report(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.llm import token_output

    return token_output.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_token_output": op10_token_output,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": OP4_SQL,
}
