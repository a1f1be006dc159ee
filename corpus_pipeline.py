"""The corpus pipeline: quality, exact and near duplicates, decontamination, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what it
keeps. Each stage's result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents; the last returns what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontamination, exact_dedup, mixing, ngram_join, quality
from leafmill.llm._common import scratch_path, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_distinct(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts."""
    return ngram_join.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in passages of the benchmark."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: doc_id, source, size, source_size, target, taken, passes."""
    return mixing.mix(docs).where("passes > 0")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: SQL can't express the classifier or the near copies' classes; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
