"""The scan: files and rules in, findings and metrics out."""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as X
from ..functions.languages import code_lines
from ..model import FINDING, FINDING_COLUMNS, ORDER
from ..operators import baseline, boundary, coverage, duplication, facts, markers, matching, syntax
from ..rulesets.loader import Rule, RuleSet, require_rules
from ..session import checkpointed

if TYPE_CHECKING:
    from ..streaming.incremental import Cache


class SetupError(ValueError):
    """The rules ask for something that the scan wasn't given."""


@dataclass
class Report:
    findings: DataFrame
    baselined: DataFrame
    suppressed: DataFrame
    skipped: DataFrame
    metrics: DataFrame
    totals: DataFrame
    edges: DataFrame | None = None
    redacted: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    anchor: str = "scan-root"
    ignored: tuple[int, int] = (0, 0)

    def rows(self) -> DataFrame:
        """All findings with ``status``."""
        parts = ((self.findings, "new"), (self.baselined, "baselined"), (self.suppressed, "suppressed"))
        return functools.reduce(DataFrame.unionByName, (d.withColumn("status", F.lit(s)) for d, s in parts))


def file_metrics(files: DataFrame, min_lines: int = duplication.MIN_LINES, copies: DataFrame | None = None) -> DataFrame:
    """(path, lines, code_lines, duplicated_lines)."""
    f = matching.with_language(files)
    counted = f.select("path", X.count_lines("content").alias("lines"), code_lines("content", "language").alias("code_lines"))
    return counted.join(duplication.duplicated_lines(files, min_lines, copies), "path", "left").select("path", "lines", "code_lines", F.coalesce("duplicated_lines", F.lit(0)).alias("duplicated_lines"))


def totals(metrics: DataFrame) -> DataFrame:
    """One row: lines, code lines (null where no file has them), duplicated lines, density."""
    summed = metrics.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.sum("code_lines").alias("code_lines"), F.coalesce(F.sum("duplicated_lines"), F.lit(0)).alias("duplicated_lines"))
    return summed.withColumn("duplication_density", X.density("duplicated_lines", "lines"))


def with_status(found: DataFrame, marks: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """``found`` with status: suppressed by a marker, else baselined where the fingerprint is accepted, else new. One join for each."""
    m = marks.select("path", "line", "rule_id").distinct().withColumn("marked", F.lit(True))
    out = found.join(m, ["path", "line", "rule_id"], "left")
    if accepted is None:
        return out.select(*found.columns, F.when(F.col("marked"), "suppressed").otherwise("new").alias("status"))
    out = out.join(accepted.select("fingerprint").distinct().withColumn("known", F.lit(True)), "fingerprint", "left")
    return out.select(*found.columns, F.when(F.col("marked"), "suppressed").when(F.col("known"), "baselined").otherwise("new").alias("status"))


class Scanner:
    """Scans tables of files under a set of rules. Plans are built only for the kinds of rules that there are."""

    def __init__(self, spark: SparkSession, rules: RuleSet, config: Config | None = None, cache: Cache | None = None):
        """``cache`` keeps what rules that look at one file found, from scan to scan."""
        self.spark, self.rules, self.config, self.cache = spark, require_rules(rules), config or Config(), cache

    def _setup(self, report: DataFrame | None) -> None:
        silos = self.config.silos
        for r in self.rules.of("coverage")[:1]:
            if report is None:
                raise SetupError(f"rule {r.id}: a coverage report is needed")
        for r in self.rules.of("boundary"):
            if not silos:
                raise SetupError(f"rule {r.id}: boundaries need silos")
            for name in (r.source, *r.deny):
                if name not in silos:
                    raise SetupError(f"rule {r.id}: there is no silo {name!r}")
        for r in self.rules.of("duplication"):
            if r.scope == "silo" and not silos:
                raise SetupError(f"rule {r.id}: a gate by silo needs silos")

    def scan(self, files: DataFrame, accepted: DataFrame | None = None, report: DataFrame | None = None, skipped: DataFrame | None = None, partial: bool = False) -> Report:
        """``files`` has path and content; ``report`` is a coverage table; ``partial`` turns a report without matches into a warning."""
        from ..streaming.incremental import scan_batch

        self._setup(report)
        files = matching.with_language(files.where(F.col("content").isNotNull()))
        parts, warnings, edges = [], [], None
        if self.cache is not None and self.rules.of("regex", "secret", "ast"):
            found, rows = scan_batch(files, self.rules, self.cache.read(), self.cache.salt, self.config.anchor, self.config.max_parse_bytes)
            self.cache.write(rows, uuid.uuid4().hex)
            parts.append(found)
        else:
            if some := self.rules.of("regex", "secret"):
                parts.append(matching.findings(files, some))
            if some := self.rules.of("ast"):
                parts.append(syntax.findings(files, some, self.config.max_parse_bytes))
        warnings += syntax.unparsed(self.rules.of("ast"))
        silos = boundary.silo_of(files, self.config.silos) if self.config.silos else None
        if some := self.rules.of("boundary"):
            resolved = boundary.resolve(facts.import_table(files, self.config.max_parse_bytes), files, self.config.source_roots, boundary.go_modules(files))
            found = boundary.violations(resolved, silos, some)
            edges = found.select("from_silo", "to_silo", "fingerprint").distinct()
            parts.append(found.select(*FINDING_COLUMNS))
        if some := self.rules.of("coverage"):
            resolved = coverage.resolve(report, files)
            if resolved.isEmpty():
                said = f"rule {some[0].id}: the coverage report names none of the scanned files"
                if not partial or report.isEmpty():
                    raise SetupError(said)
                warnings.append(said)
            parts += [coverage.gate(r, resolved) for r in some]
        copies = checkpointed(duplication.copies(files, self.config.min_lines))
        metrics = file_metrics(files, self.config.min_lines, copies)
        parts += [duplication.gate(r, metrics, silos) for r in self.rules.of("duplication")]
        if self.config.report_blocks:
            parts.append(duplication.block_findings(copies))
        found = functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], FINDING)
        found = checkpointed(found)  # the lists below are parts of it: it is computed once and written, being small beside the files
        marks = markers.suppressions(files)
        kept, silenced = markers.kept(found, marks), markers.silenced(found, marks)
        known = baseline.known(kept, accepted) if accepted is not None else kept.limit(0)
        new = baseline.new(kept, accepted) if accepted is not None else kept
        big = syntax.oversized(files, self.rules.of("ast", "boundary"), self.config.max_parse_bytes)
        skips = big if skipped is None else skipped.select("path", "reason").unionByName(big)
        return Report(
            *(d.orderBy(*ORDER) for d in (new, known, silenced)), skips.orderBy("path"), metrics, totals(metrics), edges, self.rules.redacted(), warnings, self.config.anchor
        )


def min_severity(findings: DataFrame, least: str) -> DataFrame:
    """Findings of at least this severity; only what is shown changes, not what is found."""
    return findings.where(X.severity_rank("severity") >= X.severity_rank(F.lit(least)))


def withheld(findings: DataFrame, least: str) -> DataFrame:
    return findings.agg(F.count_if(X.severity_rank("severity") < X.severity_rank(F.lit(least))).alias("withheld"))


def fails(new: DataFrame, at: str) -> bool:
    """Whether a new finding reaches the severity that fails a run."""
    return not min_severity(new, at).limit(1).isEmpty()


def rules_of(rules: list[Rule], kind: str) -> list[Rule]:
    return [r for r in rules if r.kind == kind]
