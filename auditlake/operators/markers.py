"""Marker comments: suppressions and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.languages import comment_prefix, detect
from ..model import FINDING_COLUMNS

IGNORE, EXPECT = "auditlake-ignore", "auditlake-expect"


def ids_after(tail: Column) -> Column:
    """The comma-separated ids at the start of a text; the first token that is no id ends them."""
    tokens = F.transform(F.split(tail, ","), lambda t: F.regexp_extract(t, r"^(?U:\s*)(\S*)", 1))
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(True).alias("on"))
    return F.aggregate(
        tokens, start,
        lambda a, t: F.struct(F.when(a["on"] & t.rlike(r"^[A-Za-z0-9._-]+\z"), F.concat(a["ids"], F.array(t))).otherwise(a["ids"]).alias("ids"), (a["on"] & t.rlike(r"^[A-Za-z0-9._-]+\z")).alias("on")),
        lambda a: a["ids"],
    )


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line, text) for every physical line."""
    return files.select("path", F.posexplode(X.lines("content")).alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line"), "text")


def suppressions(files: DataFrame, marker: str = IGNORE) -> DataFrame:
    """(path, line, rule_id): ``marker: ids`` silences the next line, ``marker-line: ids`` its own."""
    with_marker = files.where(F.contains("content", F.lit(marker)))
    parts = numbered_lines(with_marker).where(F.contains("text", F.lit(marker))).select("path", "line", F.posexplode(F.split("text", marker.replace("-", r"\-"), -1)).alias("k", "rest")).where("k > 0")
    own, following = F.startswith("rest", F.lit("-line:")), F.startswith("rest", F.lit(":"))
    aimed = parts.where(own | following).select(
        "path", F.when(own, F.col("line")).otherwise(F.col("line") + 1).alias("line"), F.explode(ids_after(F.when(own, F.expr("substring(rest, 7)")).otherwise(F.expr("substring(rest, 2)")))).alias("rule_id")
    )
    return aimed.distinct()


def expectations(files: DataFrame, marker: str = EXPECT) -> DataFrame:
    """(path, line, rule_id) that markers announce for the next line."""
    parts = numbered_lines(files.where(F.contains("content", F.lit(marker)))).select("path", "line", F.posexplode(F.split("text", marker.replace("-", r"\-"), -1)).alias("k", "rest")).where("k > 0")
    return parts.where(F.startswith("rest", F.lit(":"))).select("path", (F.col("line") + 1).alias("line"), F.explode(ids_after(F.expr("substring(rest, 2)"))).alias("rule_id")).distinct()


def kept(findings: DataFrame, marks: DataFrame) -> DataFrame:
    return findings.join(marks.select("path", "line", "rule_id"), ["path", "line", "rule_id"], "left_anti").select(*findings.columns)


def silenced(findings: DataFrame, marks: DataFrame) -> DataFrame:
    return findings.join(marks.select("path", "line", "rule_id"), ["path", "line", "rule_id"], "left_semi").select(*findings.columns)


def insert_marker(content: Column | str, path: Column | str, line: Column | str, rule_id: Column | str, marker: str = IGNORE) -> Column:
    """The content with a same-line marker at the end of a line; as it was where the line has one already or isn't there. Line ends stay as they are."""
    c, p, n, r = (F.col(x) if isinstance(x, str) else x for x in (content, path, line, rule_id))
    cut = F.split(c, "\n", -1)
    old = F.get(cut, (n - 1).cast("int"))
    cr = F.when(F.endswith(old, F.lit("\r")), "\r").otherwise("")
    bare = F.regexp_replace(old, r"\r\z", "")
    note = F.concat(bare, F.lit(" "), F.coalesce(comment_prefix(detect(p, c)), F.lit("#")), F.lit(f" {marker}-line: "), r, cr)
    there = F.contains(bare, F.concat(F.lit(f"{marker}-line: "), r))
    return F.when(old.isNull() | there, c).otherwise(F.array_join(F.transform(cut, lambda x, i: F.when(i == n - 1, note).otherwise(x)), "\n"))


def compare(expected: DataFrame, findings: DataFrame, marker_lines: DataFrame | None = None) -> DataFrame:
    """(path, line, rule_id, outcome): matched, missing or unexpected. Findings on the markers' own lines don't count."""
    actual = findings.select("path", "line", "rule_id").distinct()
    if marker_lines is not None:
        actual = actual.join(marker_lines.select("path", "line").distinct(), ["path", "line"], "left_anti")
    a, b = expected.distinct().withColumn("e", F.lit(True)), actual.withColumn("f", F.lit(True))
    joined = a.join(b, ["path", "line", "rule_id"], "full_outer")
    return joined.select("path", "line", "rule_id", F.when(F.col("e") & F.col("f"), "matched").when(F.col("e"), "missing").otherwise("unexpected").alias("outcome"))


def all_findings_columns(df: DataFrame) -> DataFrame:
    return df.select(*FINDING_COLUMNS)
