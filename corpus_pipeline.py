"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage but the last returns the columns of documents; further columns of the
table it is given, whatever they are called, do not come along. Stages take null
identifiers and texts, empty texts, repeated rows and empty tables; what becomes
of these stands at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.llm import decontaminate, line_dedup, packing, quality_crf, simhash
from marlspark.llm.common import table, texts
from marlspark.llm.registry import tokenizer_path
from marlspark.sources.storage import delete, scope, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, learned from the labels, rejects.

    A text without a word (null and empty ones too) has score 0 and goes. Repeated
    rows are judged alike, each on its own; so is a row without doc_id. Without
    labels of both classes nothing is known of good and bad: a text with a word has
    the share of label 1 (without labels 0.5) and stays if that reaches 0.3.
    """
    return quality_crf.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels", "doc_id", "quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; every document stays, n_chars counts its text anew.

    A text of which nothing is left stays as an empty one. Null and empty texts stay
    as they are. Rows of equal doc_id and text are one document, none of them the
    later; a null doc_id comes first.
    """
    done = line_dedup.dedup(docs.select(*COLUMNS))
    length = F.when(F.col("line_dedup.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", length).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id.

    Null and empty texts are duplicates of one another. Of equal rows one stays; a
    row without doc_id stays only if no other of its group has one.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null and empty texts hold none, and null and empty items stand nowhere. All rows
    of a doc_id go if one of its texts holds an item, those without doc_id too.
    Without a benchmark all documents stay.
    """
    return decontaminate.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places each document's pieces in sequences.

    A null or empty text is its end token alone. Repeated rows are placed each on
    their own. No documents make no sequences.
    """
    return packing.packed(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontaminate", benchmark), ("pack", pack)]

#: SQL can express neither the trained classifier nor XXH64 and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again.

    When a stage is written, what it and the one before have left there goes.
    """
    docs, before = texts(spark, sf_dir, "documents", *COLUMNS), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        with scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.mode("overwrite").parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
