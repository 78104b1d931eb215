"""The corpus pipeline: five stages over ``documents``, each of which works on all that its predecessor kept.

Quality classifier, exact dedup, SimHash near-dedup, benchmark decontamination, BPE. Every stage but the last returns the
columns of ``documents``; the last returns the token ids of what is left. :func:`run` writes what a stage returns as
Parquet in the folder that all executors share and reads it again for the next.

SQL can't express the classifier's fit, the sketches or BPE, so ``ORACLE_SQL`` is None and the tests hold the result
against a brute-force version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import bpe, decontam, exactdedup, quality, simhash
from auditlake.session import discard, prepare, shared_dir, table


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, keeps."""
    prepare(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def each_text_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.drop_copies(docs)


def near_copies_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_only),
    ("exact_dedup", each_text_once),
    ("simhash_near_dedup", near_copies_once),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            discard(spark, before)
        before = at
    return docs
