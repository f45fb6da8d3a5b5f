"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, packing, quality_crf, quality_rules, secret_scan, simhash, toxicity, warc
from .common import table, texts


def tokenizer_path() -> str:
    """The public vocabulary file that op7 names; another path can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(texts(spark, sf_dir, "documents", "doc_id", "text")).drop("matches")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return quality_crf.score(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(texts(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(texts(spark, sf_dir, "documents", "doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(texts(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "line_dedup.removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(texts(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(texts(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(texts(spark, sf_dir, "documents", "doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(texts(spark, sf_dir, "documents", "doc_id", "text", "lang"))


OPERATORS = (op1_license_scan, op2_quality, op3_warc, op4_simhash, op5_line_dedup, op6_decontaminate, op7_packing, op8_toxicity, op9_secret_scan, op10_quality_rules)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

SQL: dict[str, str] = {
    "op1_license_scan": license_scan.sql(),
    "op3_warc": warc.SQL,
    "op5_line_dedup": line_dedup.sql(),
    "op10_quality_rules": quality_rules.sql(),
}
