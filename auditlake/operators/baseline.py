"""Accepted findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings whose fingerprint isn't accepted."""
    return findings.join(accepted.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*findings.columns)


def known(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    return findings.join(accepted.select("fingerprint").distinct(), "fingerprint", "left_semi").select(*findings.columns)


def entries(findings: DataFrame) -> DataFrame:
    return findings.select("fingerprint", "rule_id", "path")


def upsert(accepted: DataFrame, more: DataFrame) -> DataFrame:
    """Both, with each fingerprint once: its first row by path and rule."""
    first = Window.partitionBy("fingerprint").orderBy("path", "rule_id")
    both = accepted.select("fingerprint", "rule_id", "path").unionByName(entries(more))
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
