"""Reports: JSON, SARIF 2.1.0, text, baselines and parity tables.

A report is one document. :func:`json_report` and the others that give a text make it on the driver, for reports that fit there;
:func:`write_json_report` writes the same text at any size, and the tables behind it can be written by ``report.rows().write``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import FINDING_COLUMNS, ORDER, RANK
from ..plans.scan import Report, fails
from ..rulesets.loader import RESERVED, RuleSet
from ..session import discard, shared_dir, temporary

SCHEMA_VERSION = "1.2"
REDACTED = "<redacted>"
WARNED, SARIF_SKIPS = 10, 100
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"


def redacted(findings: DataFrame, ids: list[str]) -> DataFrame:
    """Findings with the match text of these rules withheld."""
    shown = F.when(F.col("rule_id").isin(*ids), REDACTED).otherwise(F.col("matched")) if ids else F.col("matched")
    return findings.withColumn("matched", shown)


def _json_findings(d: DataFrame, ids: list[str], least: str | None) -> DataFrame:
    if least:
        d = d.where(X.severity_rank("severity") >= RANK[least])
    return redacted(d, ids).orderBy(*ORDER).select(*(c for c in FINDING_COLUMNS if c != "column_utf16"))


def _drop(d: dict) -> dict:
    return {k: v for k, v in d.items() if v is not None}


def _document(report: Report, version: str, least: str | None, findings: list, baselined: list, suppressed: list, skipped: list, files: dict) -> str:
    t = report.totals.first()
    out = {
        "version": version, "findings": findings, "baselined": baselined, "suppressed": suppressed, "skipped": skipped, "schema_version": SCHEMA_VERSION,
        "metrics": {"files": files, "totals": _drop({"lines": t["lines"], "code_lines": t["code_lines"], "duplicated_lines": t["duplicated_lines"], "duplication_density": t["duplication_density"]})},
        "anchor": report.anchor, "ignored": {"files": report.ignored[0], "directories": report.ignored[1]}, "warnings": report.warnings,
    }
    if least:
        out["min_severity"] = least
    return json.dumps(out, indent=2, ensure_ascii=False)


_COUNTS = ("lines", "code_lines", "duplicated_lines")


def json_report(report: Report, version: str = "0.1.0", least: str | None = None) -> str:
    lists = [[r.asDict() for r in _json_findings(d, report.redacted, least).collect()] for d in (report.findings, report.baselined, report.suppressed)]
    skipped = [r.asDict() for r in report.skipped.orderBy("path").collect()]
    return _document(report, version, least, *lists, skipped, {r["path"]: _drop({k: r[k] for k in _COUNTS}) for r in report.metrics.orderBy("path").collect()})


def _texts(rows: DataFrame, indent: int, key: str | None = None) -> DataFrame:
    """(value): each row as an entry of an indented JSON list, or of an object under its ``key``, with the comma behind it."""
    pad = " " * indent

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                name = f"{json.dumps(r.pop(key), ensure_ascii=False)}: " if key else ""
                text = json.dumps(_drop(r) if key else r, indent=2, ensure_ascii=False)
                out.append(pad + name + text.replace("\n", "\n" + pad) + ",")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def ordered_bytes(rows: DataFrame, but: int = 1) -> Iterator[bytes]:
    """The lines of (value) in the order of its partitions, without the last ``but`` bytes, a piece at a time: executors write them to the shared folder."""
    import pyarrow.fs as pafs

    folder = f"{shared_dir(rows.sparkSession).rstrip('/')}/text-{uuid.uuid4().hex}"
    rows.write.option("compression", "none").text(temporary(folder))
    fs, at = pafs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (pafs.LocalFileSystem(), folder)
    held = b""
    for name in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and f.base_name.startswith("part-")):
        with fs.open_input_stream(name) as part:
            while piece := part.read(1 << 20):
                held += piece
                if len(held) > but:
                    yield held[: len(held) - but]
                    held = held[len(held) - but :]
    discard(rows.sparkSession, folder)


def write_json_report(report: Report, path: str | Path, version: str = "0.1.0", least: str | None = None) -> dict[str, tuple[int, int]]:
    """The text of :func:`json_report` as a file, of any size: executors write the entries of its lists, which are joined a piece at a time. Where (bytes) the entries of each list are."""
    mark = uuid.uuid4().hex
    names = ("findings", "baselined", "suppressed", "skipped", "files")
    lists = [_texts(_json_findings(d, report.redacted, least), 4) for d in (report.findings, report.baselined, report.suppressed)]
    lists.append(_texts(report.skipped.select("path", "reason").orderBy("path"), 4))
    lists.append(_texts(report.metrics.select("path", *_COUNTS).dropDuplicates(["path"]).orderBy("path"), 6, "path"))
    rest = _document(report, version, least, *([f"{mark}{n}"] for n in names[:4]), {f"{mark}files": 0})
    where = {}
    with open(f"{path}.part", "wb") as out:
        for name, rows in zip(names, lists):
            own = f'"{mark}{name}"' + (": 0" if name == "files" else "")
            head, _, rest = rest.partition(own)
            out.write(head.rstrip().encode())
            start = out.tell() + 1
            for k, piece in enumerate(ordered_bytes(rows, 2)):
                out.write(piece if k else b"\n" + piece)
            where[name] = (start, max(start, out.tell()))
            rest = rest if out.tell() > start else rest.lstrip()
        out.write(rest.encode())
    os.replace(f"{path}.part", path)
    return where


def json_entries(spark: SparkSession, path: str | Path, where: tuple[int, int], indent: int = 4, piece: int = 16 << 20) -> DataFrame:
    """(value): the entries of a list of such a file, in order, read by executors in pieces of the file, which all see."""
    path, (start, end) = str(path), where
    pieces = spark.range(0, -(-(end - start) // piece), 1, max(1, -(-(end - start) // piece)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in b.column(0).to_pylist():
                for some in _pieces(path, start + k * piece, min(end, start + (k + 1) * piece), start, indent):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["value"])

    return pieces.mapInArrow(run, "value string")


def json_outline(path: str | Path, where: dict[str, tuple[int, int]]) -> dict:
    """Such a file without the entries of its lists."""
    out, at = b"", 0
    with open(path, "rb") as f:
        for start, end in [*where.values(), (os.path.getsize(path), 0)]:
            f.seek(at)
            out += f.read(start - at)
            at = end
    return json.loads(out)


def _pieces(path: str, a: int, b: int, start: int, indent: int, most: int = 2000) -> Iterator[list[str]]:
    """Lists of the entries that begin from byte ``a`` on and before ``b``; one that goes on behind is read to its end."""
    pad = b" " * indent
    with open(path, "rb") as f:
        f.seek(a - (a > start))
        if a > start:
            f.readline()
        some, entry, at = [], [], f.tell()
        while entry or at < b:
            line = f.readline()
            at += len(line)
            inner = line[indent : indent + 1] if line.startswith(pad) else b""
            if inner in (b"{", b'"'):
                entry = [line]
            elif inner == b" ":
                entry += [line] * bool(entry)  # else it is of an entry that began before
            elif inner == b"}":
                if entry:
                    some.append(b"".join([*entry, line]).decode().strip().rstrip(","))
                if len(some) == most:
                    yield some
                    some = []
                entry = []
            else:
                break
        if some:
            yield some


def write_json_lines(report: Report, folder: str) -> None:
    """A report of any size: findings with their status, metrics and skipped files as JSON lines, which executors write."""
    redacted(report.rows(), report.redacted).orderBy("status", *ORDER).write.mode("overwrite").json(f"{folder}/findings")
    report.metrics.orderBy("path").write.mode("overwrite").json(f"{folder}/files")
    report.totals.write.mode("overwrite").json(f"{folder}/totals")
    report.skipped.orderBy("path").write.mode("overwrite").json(f"{folder}/skipped")


def write_sarif_lines(report: Report, folder: str) -> None:
    """The results of a SARIF run, one to a line, which executors write."""
    sarif_results(report.findings, report.redacted).orderBy(*ORDER[:3], "rule_id").select("result").write.mode("overwrite").text(folder)


def sarif_results(findings: DataFrame, ids: list[str] = ()) -> DataFrame:
    """(rule_id, level, result): one SARIF result, as JSON, for each finding."""
    place = F.struct(F.struct(F.struct(X.uri_reference("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.greatest("column_utf16", F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), X.sarif_level("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.col("fingerprint").alias("primary/v1")).alias("partialFingerprints"),
    )
    return redacted(findings, list(ids)).select("rule_id", X.sarif_level("severity").alias("level"), F.to_json(result).alias("result"), *ORDER[:3])


def sarif_report(report: Report, rules: RuleSet, version: str = "0.1.0", least: str | None = None) -> str:
    new = report.findings if not least else report.findings.where(X.severity_rank("severity") >= RANK[least])
    results = [json.loads(r["result"]) for r in sarif_results(new, report.redacted).orderBy(*ORDER[:3], "rule_id").collect()]
    used = sorted({r["ruleId"] for r in results})
    by_id = {r.id: r for r in rules.rules}
    level = {"error": "error", "warning": "warning", "info": "note"}
    descriptors = [
        {"id": i, "shortDescription": {"text": by_id[i].message}, "defaultConfiguration": {"level": level[by_id[i].severity]}} if i in by_id else
        {"id": i, "shortDescription": {"text": "A block of lines that occurs more than once."}, "defaultConfiguration": {"level": "note"}} for i in used
    ]
    skipped = report.skipped.orderBy("path").limit(SARIF_SKIPS).collect()
    hidden = report.skipped.count() - len(skipped)
    said = [("warning", w) for w in report.warnings] + [("note", f"skipped {r['path']}: {r['reason']}") for r in skipped]
    said += [("note", f"{hidden} more files were skipped")] if hidden else []
    notes = [dict(level=k, message=dict(text=w)) for k, w in said]
    t = report.totals.first().asDict()
    run = {
        "tool": dict(driver=dict(name="auditlake", version=version, rules=descriptors)), "columnKind": "utf16CodeUnits", "results": results,
        "invocations": [{"executionSuccessful": True, "toolExecutionNotifications": notes}], "properties": {"metrics": {k: v for k, v in t.items() if v is not None}},
    }
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


def listing(findings: DataFrame) -> Column:
    """``path:line:column severity rule message``, safe for a terminal."""
    return F.concat(X.sanitize("path"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"), F.lit(" "), F.col("severity"), F.lit(" "), F.col("rule_id"), F.lit(" "), X.sanitize("message"))


def listed(findings: DataFrame) -> DataFrame:
    return findings.select("path", "line", "column", "rule_id", listing(findings).alias("text"))


def metrics_line(totals: DataFrame) -> DataFrame:
    """(text): one line over the totals; code lines are left out where no file has them."""
    code = F.when(F.col("code_lines").isNotNull(), F.concat(F.lit(", "), X.quantity("code_lines", "code line"))).otherwise("")
    return totals.select(F.concat(X.quantity("lines", "line"), code, F.lit(", "), F.col("duplicated_lines").cast("string"), F.lit(" duplicated ("), X.one_decimal("duplication_density"), F.lit("%)")).alias("text"))


def skip_warnings(skipped: DataFrame) -> list[str]:
    return [r["text"] for r in skip_notes(skipped).orderBy("k").collect()]


def text_report(report: Report, least: str | None = None) -> str:
    from ..sources.files import ignored_summary

    shown = report.findings if not least else report.findings.where(X.severity_rank("severity") >= RANK[least])
    lines = [r["text"] for r in listed(shown).orderBy(*ORDER).collect()]
    counts = [d.count() for d in (report.findings, report.baselined, report.suppressed)]
    lines.append(", ".join(f"{n} {w}" for n, w in zip(counts, ("new", "baselined", "suppressed"))))
    if said := ignored_summary(*report.ignored):
        lines.append(said)
    if least and (n := report.findings.count() - shown.count()):
        lines.append(f"{n} below {least} not shown")
    lines.append(metrics_line(report.totals).first()["text"])
    return "\n".join(lines) + "\n"


def write_atomically(path: str | Path, text: str) -> None:
    part = Path(f"{path}.part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)


def write_baseline(findings: DataFrame, path: str | Path) -> None:
    """The accepted findings, sorted, in one replacement of the file."""
    rows = findings.select("fingerprint", "rule_id", "path").orderBy("fingerprint", "path", "rule_id").collect()
    write_atomically(path, json.dumps({"version": 1, "entries": [r.asDict() for r in rows]}, indent=2, ensure_ascii=False) + "\n")


def parity(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, line, bucket) over two findings tables (path, line, rules array): same, differing, only-ours, only-theirs."""
    j = ours.withColumnRenamed("rules", "a").join(theirs.withColumnRenamed("rules", "b"), ["path", "line"], "full_outer")
    return j.select("path", "line", F.when(F.col("b").isNull(), "only-ours").when(F.col("a").isNull(), "only-theirs").when(F.arrays_overlap("a", "b"), "same").otherwise("differing").alias("bucket"))


def parity_counts(rows: DataFrame) -> DataFrame:
    """(bucket, places) over the rows of :func:`parity`, zeros included."""
    every = rows.sparkSession.createDataFrame([(b,) for b in ("same", "differing", "only-ours", "only-theirs")], "bucket string")
    return every.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("places"))


def parity_tsv(rows: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, line, text): tab-separated lines of the places that differ, with the rules of either side (- for none)."""
    shown = lambda c: F.coalesce(F.array_join(c, ";"), F.lit("-"))
    j = rows.where("bucket <> 'same'").join(ours.withColumnRenamed("rules", "a"), ["path", "line"], "left").join(theirs.withColumnRenamed("rules", "b"), ["path", "line"], "left")
    return j.select("path", "line", F.concat_ws("\t", "path", F.col("line").cast("string"), shown("b"), shown("a"), "bucket").alias("text"))


def rules_per_line(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path", "line").agg(F.sort_array(F.collect_set("rule_id")).alias("rules"))


def exit_status(report: Report, fail_on: str = "error") -> int:
    """1 where a new finding reaches the severity, before anything is filtered for output; else 0."""
    return int(fails(report.findings, fail_on))


def skip_notes(skipped: DataFrame) -> DataFrame:
    """(k, text): what a listing says of skipped files, the first ``WARNED`` by path and the number of the others."""
    first = skipped.orderBy("path").limit(WARNED).select(F.row_number().over(Window.orderBy("path")).cast("long").alias("k"), F.concat(F.lit("skipped "), X.sanitize("path"), F.lit(": "), X.sanitize("reason")).alias("text"))
    more = skipped.agg((F.count(F.lit(1)) - WARNED).alias("n")).where("n > 0").select(F.lit(WARNED + 1).cast("long").alias("k"), F.concat(F.lit("... and "), F.col("n").cast("string"), F.lit(" more")).alias("text"))
    return first.unionByName(more)


def descriptor_ids(findings: DataFrame) -> DataFrame:
    return findings.select("rule_id").distinct().withColumn("builtin", F.col("rule_id") == RESERVED)
