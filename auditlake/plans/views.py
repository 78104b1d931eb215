"""Dashboards over findings with ``status``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.paths import top_dir
from ..model import ORDER, SEVERITIES, STATUSES

UNASSIGNED = "(unassigned)"


def _dimension(rows: DataFrame, values: tuple[str, ...], name: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values)], f"{name} string, rank int")


def severity_counts(rows: DataFrame) -> DataFrame:
    """(severity, findings), zeros included."""
    dim = _dimension(rows, SEVERITIES, "severity")
    return F.broadcast(dim).join(rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("findings"))


def status_counts(rows: DataFrame) -> DataFrame:
    dim = _dimension(rows, STATUSES, "status")
    return F.broadcast(dim).join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("findings"))


def debt(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES))


def top_rules(rows: DataFrame, n: int = 8) -> DataFrame:
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings")).orderBy(F.desc("findings"), "rule_id").limit(n)


def dir_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(top_dir("path").alias("dir")).agg(F.count(F.lit(1)).alias("findings"))


def worst_by_dir(rows: DataFrame) -> DataFrame:
    rank = F.max(X.severity_rank("severity"))
    worst = F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), rank + 1)
    return rows.groupBy(top_dir("path").alias("dir")).agg(worst.alias("worst"))


def matrix(edges: DataFrame) -> DataFrame:
    """(from_silo, to_silo, violations) over all pairs of the silos that take part, zeros included."""
    who = edges.select(F.col("from_silo").alias("s")).union(edges.select(F.col("to_silo").alias("s"))).distinct()
    pairs = who.select(F.col("s").alias("from_silo")).crossJoin(who.select(F.col("s").alias("to_silo")))
    n = edges.groupBy("from_silo", "to_silo").agg(F.countDistinct("fingerprint").alias("n"))
    return pairs.join(n, ["from_silo", "to_silo"], "left").select("from_silo", "to_silo", F.coalesce("n", F.lit(0)).alias("violations"))


def pivoted(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_silo").pivot("to_silo").agg(F.countDistinct("fingerprint")).na.fill(0)


def silo_cards(rows: DataFrame, metrics: DataFrame, silos: DataFrame, declared: list[str] | None = None) -> DataFrame:
    """(silo, info, warning, error, lines, duplication): silos without rows stay, paths of none count as unassigned."""
    counts = rows.join(silos, "path", "left").groupBy(F.coalesce("silo", F.lit(UNASSIGNED)).alias("silo")).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    sizes = metrics.join(silos, "path", "left").groupBy(F.coalesce("silo", F.lit(UNASSIGNED)).alias("silo")).agg(F.sum("lines").alias("lines"), F.sum("duplicated_lines").alias("dup"))
    names = silos.select("silo").distinct() if declared is None else rows.sparkSession.createDataFrame([(s,) for s in declared], "silo string")
    every = names.union(counts.select("silo")).union(sizes.select("silo")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(counts, "silo", "left").join(sizes, "silo", "left").select("silo", *(zero(s) for s in SEVERITIES), zero("lines"), X.density(F.coalesce("dup", F.lit(0)), F.coalesce("lines", F.lit(0))).alias("duplication"))


def rating(rows: DataFrame) -> DataFrame:
    new = F.col("status") == "new"
    return rows.agg(F.count_if(new & (F.col("severity") == "error")).alias("e"), F.count_if(new & (F.col("severity") == "warning")).alias("w")).select(X.rating("e", "w").alias("rating"))


def gate(rows: DataFrame) -> DataFrame:
    """PASSED without new errors, else FAILED."""
    return rows.agg(F.when(F.count_if((F.col("status") == "new") & (F.col("severity") == "error")) == 0, "PASSED").otherwise("FAILED").alias("verdict"))


def kpis(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """One row of headline numbers: severities, debt, coverage findings, density, lines."""
    s = rows.agg(
        *(F.count_if(F.col("severity") == x).alias(f"{x}s") for x in SEVERITIES), F.count_if(F.col("status") != "new").alias("debt"), F.count_if(X.is_coverage_text("matched")).alias("coverage_findings")
    )
    return s.crossJoin(totals.select("lines", "duplicated_lines", "duplication_density"))


def filtered(rows: DataFrame, rules: list[str] | None = None, severities: list[str] | None = None, statuses: list[str] | None = None, paths: list[str] | None = None, text: str = "") -> DataFrame:
    """AND of the given sets (an empty one doesn't constrain) and a text in path, rule or message, in any case."""
    out: Column = F.lit(True)
    for column, values in (("rule_id", rules), ("severity", severities), ("status", statuses), ("path", paths)):
        if values:
            out = out & F.col(column).isin(*values)
    if text:
        out = out & F.contains(F.lower(F.concat_ws("\n", "path", "rule_id", "message")), F.lit(text.lower()))
    return rows.where(out)


def status_rank() -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STATUSES)), F.col("status"))


def ordered(rows: DataFrame, by: str = "canonical") -> DataFrame:
    """Canonical order, or by falling severity or by rule first; ties go new, baselined, suppressed."""
    first = {"canonical": [], "severity": [X.severity_rank("severity").desc()], "rule": [F.col("rule_id")]}[by]
    return rows.orderBy(*first, *ORDER, status_rank())


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(block, copies, lines) of the duplicate-block findings, the most copied first."""
    n, key = X.duplicate_text("matched")
    return rows.withColumn("n", n).withColumn("block", key).where("block IS NOT NULL").groupBy("block").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("lines")).orderBy(F.desc("copies"), "block")


def new_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "new")


def cell(rows: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """The rows behind one cell of the matrix."""
    return rows.join(edges.where((F.col("from_silo") == source) & (F.col("to_silo") == target)).select("fingerprint").distinct(), "fingerprint", "left_semi")


def drill(card: str) -> dict:
    """The filter behind a headline card."""
    known = {"errors": {"severities": ["error"]}, "warnings": {"severities": ["warning"]}, "infos": {"severities": ["info"]}, "debt": {"statuses": ["baselined", "suppressed"]}, "new": {"statuses": ["new"]}, "duplication": {"rules": ["metrics.duplicate-block"]}}
    if card not in known:
        raise ValueError(f"there is no card {card!r}")
    return known[card]


def silo_drill(rows: DataFrame, silos: DataFrame, silo: str) -> DataFrame:
    """The rows of one silo's files, by a semi join; a silo without files is an error."""
    paths = silos.where(F.col("silo") == silo).select("path")
    if paths.isEmpty():
        raise ValueError(f"silo {silo!r} has no files")
    return rows.join(paths, "path", "left_semi")


def sections(rows: DataFrame, active: dict | None = None) -> DataFrame:
    """(section, value, findings, active): severities, statuses and the eight rules with most findings."""
    active = active or {}
    parts = (("severity", severity_counts(rows), "severities"), ("status", status_counts(rows), "statuses"), ("rule_id", top_rules(rows), "rules"))
    out = None
    for column, counts, key in parts:
        on = F.col(column).isin(*active[key]) if active.get(key) else F.lit(False)
        part = counts.select(F.lit(column).alias("section"), F.col(column).alias("value"), "findings", on.alias("active"))
        out = part if out is None else out.unionByName(part)
    return out


def context(findings: DataFrame, files: DataFrame, height: int = 5) -> DataFrame:
    """(path, line, first_line, shown): the lines around each finding, as many as ``height`` where the file has them."""
    cut = X.lines("content")
    first = F.greatest(F.lit(1), F.least(F.col("line") - height // 2, F.size("cut") - height + 1))
    return findings.select("path", "line").join(files.select("path", cut.alias("cut")), "path").select("path", "line", first.cast("long").alias("first_line"), F.slice("cut", first.cast("int"), height).alias("shown"))


def bar_cells(n: Column, total: Column, width: int) -> Column:
    """Cells of a proportional bar: at least one for anything, never more than the width."""
    return F.when(n == 0, 0).otherwise(F.least(F.lit(width), F.greatest(F.lit(1), F.round(n * width / total).cast("int"))))
