"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. The first four return
the columns of ``documents``: documents without a known language go, one document of each group of near
copies stays, documents that hold a benchmark item go, and the rest is mixed to the sources' targets (a document
that is read twice is there twice). The last one writes the token files and returns what it reads back from
them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provloom.llm import decontaminate, languages, mixing, ngramjoin, tokenfiles
from provloom.llm.registered import VOCABULARY
from provloom.llm.shared import shared_path, small_batches, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return languages.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngramjoin.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.training_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return tokenfiles.encoded(docs, VOCABULARY).drop("found_by_key")


STAGES = [
    ("language_id", known_language),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("source_mix", mixed),
    ("token_files", token_files),
]

#: no SQL: languages are learnt, near copies chain, edits are counted, and texts go through a vocabulary file
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
