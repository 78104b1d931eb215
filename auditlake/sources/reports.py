"""Readers of coverage reports, baselines, scan reports and manifests."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import normalized
from ..model import BASELINE, COVERAGE, FINDING
from ..operators.coverage import rolled_up, summed_up


class ReportError(ValueError):
    pass


def lcov(files: DataFrame) -> DataFrame:
    """Coverage from (lines): the lines of each LCOV file. A record runs from ``SF:`` to ``end_of_record``; records of one path are joined. A file's lines are cut into records where they are, without a sort."""
    trimmed = files.select(F.transform("lines", lambda x: F.trim(x)).alias("t"))
    starts = F.filter(F.transform("t", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.startswith(s["x"], F.lit("SF:")) | (s["x"] == "end_of_record"))
    marked = trimmed.select("t", starts.alias("marks"))
    end = lambda k: F.coalesce(F.get("marks", k + 1)["i"], F.size("t"))
    records = F.transform("marks", lambda m, k: F.struct(m["x"].alias("x"), F.slice("t", m["i"] + 2, end(k) - m["i"] - 1).alias("of")))
    opened = marked.select(F.explode(F.filter(records, lambda r: r["x"] != "end_of_record")).alias("r")).select(normalized(F.trim(F.substring("r.x", 4, 1 << 30))).alias("path"), F.col("r.of").alias("of")).where("path <> ''")
    none = F.lit(None).cast("long")
    number = lambda x, pattern, k=1: F.regexp_extract(x, pattern, k).cast("long")
    total = lambda name: F.array_max(F.transform(F.filter("of", lambda x: x.rlike(rf"^{name}:\s*\d+")), lambda x: number(x, rf"^{name}:\s*(\d+)")))
    row = lambda line, hits, found, hit, measured: F.struct(line.alias("line"), hits.alias("hits"), found.alias("found"), hit.alias("hit"), F.lit(measured).alias("measured"))
    da = r"^DA:\s*(\d+)\s*,\s*(\d+)"
    measured = F.transform(F.filter("of", lambda x: x.rlike(da)), lambda x: row(number(x, da), number(x, da, 2), none, none, True))
    return summed_up(opened.select("path", F.explode(F.concat(measured, F.array(row(none, none, total("LF"), total("LH"), False)))).alias("r")).select("path", "r.*"))


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """An LCOV file, read whole, so that the order of its lines is the file's."""
    return lcov(spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines")))


def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    """A Cobertura file: the lines directly under each class; those of its methods repeat them and don't count."""
    line = T.StructType([T.StructField("_number", T.StringType()), T.StructField("_hits", T.StringType())])
    schema = T.StructType([T.StructField("_filename", T.StringType()), T.StructField("lines", T.StructType([T.StructField("line", T.ArrayType(line))]))])
    classes = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    named = classes.select(normalized(F.trim("_filename")).alias("path"), F.col("lines.line").alias("lines")).where("path IS NOT NULL AND path <> ''")
    hits = named.select("path", F.explode("lines").alias("l")).select("path", F.col("l._number").try_cast("long").alias("line"), F.coalesce(F.col("l._hits").try_cast("long"), F.lit(0)).alias("hits")).where("line IS NOT NULL")
    counted = rolled_up(hits)
    return named.select("path").distinct().join(counted, "path", "left").select("path", F.coalesce("lines_total", F.lit(0)).alias("lines_total"), F.coalesce("lines_covered", F.lit(0)).alias("lines_covered"))


def coverage_format(text: str) -> str:
    """``lcov`` where a line starts with ``SF:``, ``cobertura`` where the XML's root is ``coverage``."""
    import xml.etree.ElementTree as ET

    if any(x.strip().startswith("SF:") for x in text.splitlines()):
        return "lcov"
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise ReportError(f"neither LCOV nor XML: {e}") from None
    if root.tag != "coverage":
        raise ReportError(f"the root element is {root.tag!r}, not 'coverage'")
    return "cobertura"


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    text = Path(path).read_text(encoding="utf-8", errors="replace")
    return (read_lcov if coverage_format(text) == "lcov" else read_cobertura)(spark, path)


def read_baseline(spark: SparkSession, path: str, explicit: bool = False) -> DataFrame:
    """(fingerprint, rule_id, path). An absent file is an empty baseline unless it was named; a damaged one is an error."""
    p = Path(path)
    if not p.exists():
        if explicit:
            raise ReportError(f"{path}: no such baseline")
        return spark.createDataFrame([], BASELINE)
    try:
        data = json.loads(p.read_text(encoding="utf-8"))
        rows = [(e["fingerprint"], e["rule_id"], e["path"]) for e in data["entries"]]
    except (ValueError, KeyError, TypeError) as e:
        raise ReportError(f"{path}: damaged baseline: {e}") from None
    if data.get("version") != 1:
        raise ReportError(f"{path}: baseline version {data.get('version')!r} isn't known")
    return spark.createDataFrame(rows, BASELINE)


def _finding(f: dict, status: str, old: bool = False) -> tuple:
    matched = f.get("matched", "")
    if old and f.get("rule_id") != "metrics.duplicate-block":
        matched = "<redacted>"
    return f.get("rule_id"), f.get("severity"), f.get("message"), f.get("path"), f.get("line"), f.get("column"), f.get("column_utf16", f.get("column")), matched, f.get("fingerprint"), status


def findings_of(entries: DataFrame, status: str) -> DataFrame:
    """Findings with ``status`` from (value): entries of a report of our own, read by executors, so there may be any number."""
    schema = T.StructType([*FINDING.fields, T.StructField("status", T.StringType())])
    arrow = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in schema]

    def run(batches):
        for b in batches:
            rows = [_finding(json.loads(x), status) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow)], names=schema.names)

    return entries.mapInArrow(run, schema)


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Findings with ``status`` from a JSON report of version 1.x, and its other parts; unknown keys and missing lists are accepted. Before 1.2, match text is withheld but for duplicate blocks."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except ValueError as e:
        raise ReportError(f"{path}: not JSON: {e}") from None
    if not isinstance(data, dict) or not isinstance(data.get("findings"), list):
        raise ReportError(f"{path}: no scan report")
    version = str(data.get("schema_version", "1.0"))
    major, _, minor = version.partition(".")
    if major != "1":
        raise ReportError(f"{path}: report version {version} isn't known")
    old = not minor.isdigit() or int(minor) < 2
    rows = []
    for key, status in (("findings", "new"), ("baselined", "baselined"), ("suppressed", "suppressed")):
        for f in data.get(key) or []:
            rows.append(_finding(f, status, old))
    return spark.createDataFrame(rows, T.StructType([*FINDING.fields, T.StructField("status", T.StringType())])), {k: v for k, v in data.items() if k not in ("findings", "baselined", "suppressed")}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, expect, justification) of a tab-separated manifest; ``expect`` is NONE, ANY or ids joined by bars."""
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema="path string, line long, expect string, justification string")
    return raw.withColumn("expect", F.when(F.col("expect") == "NONE", F.array().cast("array<string>")).otherwise(F.split("expect", r"\|")))


def empty_coverage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COVERAGE)
