"""Coverage reports joined to files, and the gate on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import FINDING_COLUMNS
from ..rulesets.loader import Rule
from ..session import by_size
from .matching import applies


def rolled_up(hits: DataFrame) -> DataFrame:
    """(path, lines_total, lines_covered) from (path, line, hits): a line counts as covered if any record hit it."""
    none = F.lit(None).cast("long")
    return summed_up(hits.select("path", "line", "hits", none.alias("found"), none.alias("hit"), F.lit(True).alias("measured")))


def summed_up(rows: DataFrame) -> DataFrame:
    """The same from lines (``measured``) and summaries (path, found, hit) in one table; summaries win where they have numbers; hit is at most found."""
    most = [F.max(c).alias(c) for c in ("hits", "found", "hit", "measured")]
    by_line = by_size(rows, "path").groupBy("path", "line").agg(*most)
    out = by_line.groupBy("path").agg(F.count_if("measured").alias("n"), F.count_if(F.col("hits") > 0).alias("c"), F.max("found").alias("found"), F.max("hit").alias("hit"))
    out = out.select("path", F.coalesce("found", "n").alias("n"), F.coalesce("hit", "c").alias("c"))
    return out.select("path", F.col("n").cast("long").alias("lines_total"), F.least("n", "c").cast("long").alias("lines_covered"))


def _suffixes(path: str) -> F.Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def resolve(report: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, lines_total, lines_covered) for scanned paths: exact first, then by whole-segment suffix where that is unique on both sides.

    A suffix relation either way is an equality of one path with a suffix of the other, so it is an equi-join over
    exploded suffixes and needs no comparison of all pairs.
    """
    scanned = paths.select("path").distinct()
    exact = report.join(scanned, "path").select("path", "lines_total", "lines_covered")
    pending = report.join(scanned, "path", "left_anti").select(F.col("path").alias("reported"), "lines_total", "lines_covered")
    free = scanned.join(exact.select("path"), "path", "left_anti")
    tail = pending.select("reported", F.explode(_suffixes("reported")).alias("path")).join(free, "path").select("reported", "path")
    longer = free.select("path", F.explode(_suffixes("path")).alias("reported")).join(pending.select("reported"), "reported").select("reported", "path")
    pairs = tail.unionByName(longer).where("reported <> '' AND path <> ''").distinct()
    one = pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("reported"))).where("n = 1")
    both = one.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path"))).where("n = 1").drop("n")
    return exact.unionByName(both.join(pending, "reported").select("path", "lines_total", "lines_covered"))


def gate(rule: Rule, resolved: DataFrame) -> DataFrame:
    """Findings for files below the rule's minimum; the measured value isn't part of the fingerprint."""
    p = X.coverage_percent("lines_covered", "lines_total")
    return resolved.where(applies(rule, language=F.lit(None).cast("string")) & (p < rule.limit)).select(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.message).alias("message"), "path", *(F.lit(1).cast("long").alias(c) for c in ("line", "column", "column_utf16")),
        F.concat(F.col("lines_covered").cast("string"), F.lit("/"), F.col("lines_total").cast("string"), F.lit(" lines ("), X.one_decimal(p), F.lit("%)")).alias("matched"),
        X.fingerprint(F.lit(rule.id), F.col("path"), F.lit(""), F.lit(0)).alias("fingerprint"),
    ).select(*FINDING_COLUMNS)
