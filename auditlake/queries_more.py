"""More queries: sources, rules, configuration, reports and dashboards' drill-downs, each with its SQL.

Walks, configurations and reports are files, so their queries lay small trees out in the shared folder, one entry for
each row of a dimension table, and read these; all other queries run over whole tables.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import replace
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, harness
from .functions import languages, paths
from .functions import text as X
from .model import FINDING_COLUMNS
from .operators import boundary, coverage, duplication, facts, markers, matching, syntax
from .plans import progress, ratchet, scan, views
from .queries import _ALL, _DIR, _RANK, FILES, MARKED, ROWS, _files, _findings, _q, _resolved, _rows, _silos, findings_sql, query, rules
from .queries import _ROLLED, _SCANNED, _hits
from .rulesets import loader
from .rulesets.convert import convert
from .rulesets.loader import Rule
from .session import shared_dir, spread, table, temporary
from .sinks import reports as sinks
from .sources import files as sources
from .sources import reports

ONE = "1::BIGINT"


def _folder(spark: SparkSession) -> Path:
    """A new folder beside the checkpoints; on the clusters' shared folder that is a path all nodes see."""
    out = Path(re.sub(r"^file:/+", "/", shared_dir(spark))) / f"tree-{uuid.uuid4().hex}"
    out.mkdir(parents=True)
    temporary(str(out))
    return out


def _put(root: Path, name: str, text: str | bytes) -> None:
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text if isinstance(text, bytes) else text.encode())


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, str]]:
    """(key, nation, region), 25 of them at any scale."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name").orderBy("n_nationkey").collect()
    return [(x[0], x[1], x[2].replace(" ", "_")) for x in rows]


NATIONS = "nat AS (SELECT n_nationkey AS k, n_name AS n, replace(r_name, ' ', '_') AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"


# --- walks

def _tree(spark: SparkSession, sf_dir: str) -> Path:
    """A folder for each region with a text, a log and, for some, a binary or broken file for each nation; logs and one region are ignored."""
    root = _folder(spark)
    _put(root, ".gitignore", "*.log\nASIA/\n!keep.log\n")
    for k, n, r in _nations(spark, sf_dir):
        _put(root, f"{r}/{n}.txt", n * (k + 1) if k % 5 else n.encode() + (b"\0" if k % 2 else b"\xff"))
        _put(root, f"{r}/{n}.log", "x")
        _put(root, f"{r}/.git/{n}", "x")
    _put(root, "EUROPE/keep.log", "kept")
    return root


_TREE = f"{NATIONS}, walked AS (SELECT r || '/' || n || '.txt' AS path, k, n FROM nat WHERE r <> 'ASIA' UNION ALL SELECT 'EUROPE/keep.log', -1, NULL UNION ALL SELECT '.gitignore', -2, NULL)"


@query(f"""WITH {_TREE} SELECT path, CASE WHEN k % 5 = 0 AND k >= 0 THEN CASE WHEN k % 2 = 1 THEN 'binary' ELSE 'unreadable' END ELSE 'text' END AS kind,
    CASE WHEN k = -1 THEN 4 WHEN k = -2 THEN 22 WHEN k % 5 <> 0 THEN length(n) * (k + 1) END::BIGINT AS chars, CASE WHEN k >= 0 AND k % 5 = 0 AND k % 2 = 0 THEN 'not valid UTF-8' END AS reason FROM walked""")
def walk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = sources.read_tree(spark, _tree(spark, sf_dir))
    return read.select("path", "kind", F.length("content").cast("long").alias("chars"), "reason")


@query(f"WITH {_TREE} SELECT (SELECT count(*) FROM nat WHERE r <> 'ASIA') AS ignored_files, {ONE} AS ignored_directories, 'ignored ' || (SELECT count(*) FROM nat WHERE r <> 'ASIA') || ' files and 1 directory' AS said, (SELECT count(*) FROM walked) AS files")
def walk_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sources.walk(_tree(spark, sf_dir))
    return spark.createDataFrame([(w.ignored_files, w.ignored_directories, sources.ignored_summary(w.ignored_files, w.ignored_directories), len(w.files))], "ignored_files long, ignored_directories long, said string, files long")


@query(f"""WITH {NATIONS}, a AS (SELECT r || '/' || n || e AS path FROM nat, (VALUES ('.txt'), ('.log')) v(e) UNION ALL SELECT unnest(['EUROPE/keep.log', '.gitignore']))
    SELECT policy, path FROM (SELECT 'everything' AS policy, path FROM a UNION ALL SELECT 'excluded', path FROM a WHERE NOT starts_with(path, 'AFRICA') AND NOT starts_with(path, 'ASIA') AND (NOT ends_with(path, '.log') OR path = 'EUROPE/keep.log'))""")
def walk_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree(spark, sf_dir)
    rows = [(name, p) for name, policy in (("everything", sources.Policy.everything()), ("excluded", sources.Policy(exclude=("AFRICA",)))) for p in sources.walk(root, policy).files]
    return spark.createDataFrame(rows, "policy string, path string")


@query(f"WITH {NATIONS} SELECT 'l' || k AS path, CASE k % 5 WHEN 0 THEN 'inside-root' WHEN 1 THEN 'broken' WHEN 2 THEN 'outside-root' WHEN 3 THEN 'cycle' ELSE 'cycle' END AS state FROM nat")
def walk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = _folder(spark)
    root = outer / "in"
    _put(root, "real/file", "x")
    _put(outer, "out", "x")
    for k, _, _ in _nations(spark, sf_dir):
        os.symlink({0: root / "real/file", 1: root / "gone", 2: outer / "out", 3: root, 4: root / f"l{k}"}[k % 5], root / f"l{k}")
    return spark.createDataFrame(sources.walk(root).symlinks, "path string, state string")


@query(f"WITH {NATIONS} SELECT n || '.txt' AS path FROM nat WHERE r = 'EUROPE'")
def walk_single_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree(spark, sf_dir)
    return spark.createDataFrame([(p,) for _, n, r in _nations(spark, sf_dir) if r == "EUROPE" for p in sources.walk(root / r / f"{n}.txt").files], "path string")


@query(f"WITH {NATIONS} SELECT r AS folder, n || e AS path FROM nat, (VALUES ('.txt'), ('.md')) v(e) WHERE NOT (e = '.md' AND r = 'AFRICA') AND NOT (e = '.txt' AND k % 2 = 0)")
def project_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a project, scanned one by one under the ignore files of the whole."""
    root, nations = _folder(spark), _nations(spark, sf_dir)
    _put(root, ".gitignore", "AFRICA/*.md\n" + "".join(f"{n}.txt\n" for k, n, _ in nations if k % 2 == 0))
    for _, n, r in nations:
        _put(root, f"{r}/{n}.txt", "x")
        _put(root, f"{r}/{n}.md", "x")
    rows = [(r, p) for r in sorted({r for _, _, r in nations}) for p in sources.walk(root / r, outer=sources.project_ignores(root, root / r)).files]
    return spark.createDataFrame(rows, "folder string, path string")


# --- configuration

def _project(spark: SparkSession, sf_dir: str) -> Path:
    """A versioned project whose configuration includes the modules of even nations; every module has one of its own."""
    root, nations = _folder(spark), _nations(spark, sf_dir)
    (root / ".git").mkdir()
    names = ", ".join(f'"{n}"' for k, n, _ in nations if k % 2 == 0)
    _put(root, config.NAME, f'include = [{names}]\nanchor = "config"\nsource_roots = ["top"]\n[silos]\nwhole = ["top/**"]\n[duplication]\nmin_lines = 4\n')
    for k, n, r in nations:
        _put(root, f"{n}/{config.NAME}", f'source_roots = ["src"]\n[silos]\n{n}_{r} = ["src/**", "{k}/*"]\n')
    return root


@query(f"WITH {NATIONS} SELECT n AS module, CASE WHEN k % 2 = 0 THEN '.' ELSE n END AS owner, CASE WHEN k % 2 = 0 THEN n ELSE '' END AS prefix FROM nat")
def config_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration that a scan of each module finds, and what it puts in front of paths."""
    root = _project(spark, sf_dir)
    found = [(n, config.discover(root / n)) for _, n, _ in _nations(spark, sf_dir)]
    return spark.createDataFrame([(n, c.path.parent.relative_to(root).as_posix(), c.prefix(root / n)) for n, c in found], "module string, owner string, prefix string")


@query(f"""WITH {NATIONS} SELECT 'whole' AS silo, ['top/**'] AS globs, 'top' AS source_root, 4::BIGINT AS min_lines UNION ALL
    SELECT n || '_' || r, [n || '/src/**', n || '/' || k || '/*'], n || '/src', 4 FROM nat WHERE k % 2 = 0""")
def config_silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = config.load(_project(spark, sf_dir) / config.NAME)
    rows = list(zip(c.silos, c.silos.values(), c.source_roots))
    return spark.createDataFrame([(*x, c.min_lines) for x in rows], "silo string, globs array<string>, source_root string, min_lines long")


@query(f"WITH {NATIONS} SELECT k, CASE k % 6 WHEN 0 THEN 'leaves the folder' WHEN 1 THEN 'unknown key' WHEN 2 THEN 'no silo name' WHEN 3 THEN 'not TOML' WHEN 4 THEN 'whole number' ELSE 'none' END AS fault FROM nat")
def config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ['rules = ["../x"]', "colour = 1", '[silos]\n"a b" = ["x"]', "a = = 1", "[duplication]\nmin_lines = 1", 'rules = ["x"]']
    marks = ("leaves the folder", "unknown key", "no silo name", "not TOML", "whole number")

    def fault(text: str) -> str:
        try:
            config.parse(text)
        except config.ConfigError as e:
            return next(m for m in marks if m in str(e))
        return "none"

    return spark.createDataFrame([(k, fault(f"# {n}\n{bad[k % 6]}")) for k, n, _ in _nations(spark, sf_dir)], "k long, fault string")


# --- rules

def _nation_rule(k: int, n: str) -> str:
    return f"  - {{id: nations.{n.lower().replace('_', '-')}, severity: {('info', 'warning', 'error')[k % 3]}, message: {n}, regex: {{pattern: '{n}'}}}}\n"


_RULES_SQL = "SELECT 'nations.' || lower(replace(n, '_', '-')) AS rule_id, ['info', 'warning', 'error'][k % 3 + 1] AS severity"


@query(f"WITH {NATIONS} {_RULES_SQL}, r || '/rules.' || CASE WHEN k % 2 = 0 THEN 'yml' ELSE 'yaml' END AS origin FROM nat")
def rule_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from a folder for each region, two files in each; their union is one set."""
    root, nations = _folder(spark), _nations(spark, sf_dir)
    for r in sorted({r for _, _, r in nations}):
        for half, end in ((0, "yml"), (1, "yaml")):
            _put(root, f"{r}/rules.{end}", "version: 1\nrules:\n" + "".join(_nation_rule(k, n) for k, n, s in nations if s == r and k % 2 == half))
        _put(root, f"{r}/notes.txt", "no rules")
    loaded = loader.load_dirs([root / r for r in sorted({r for _, _, r in nations})])
    origin = {rule.id: Path(o).relative_to(root).as_posix() for o, text in loaded.sources for rule in loader.load_text(text, o).rules}
    return spark.createDataFrame([(x.id, x.severity, origin[x.id]) for x in loaded.rules], "rule_id string, severity string, origin string")


@query(f"WITH {NATIONS} {_RULES_SQL}, n AS pattern FROM nat")
def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = loader.RuleSet()
    for k, n, _ in _nations(spark, sf_dir):
        out = out.merged(loader.load_text("version: 1\nrules:\n" + _nation_rule(k, n), n))
    return spark.createDataFrame([(x.id, x.severity, x.pattern) for x in out.rules], "rule_id string, severity string, pattern string")


@query(f"WITH {NATIONS} SELECT sha256(string_agg(unhex(printf('%016x', strlen(t))) || encode(t), unhex('') ORDER BY k, i)) AS digest FROM (SELECT k, unnest([1, 2]) AS i, unnest([n, r]) AS t FROM nat)".replace("string_agg(", "unhex(string_agg(hex(").replace(", unhex('') ORDER BY k, i)", "), '' ORDER BY k, i))"))
def rules_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = loader.RuleSet([], [(n, r) for _, n, r in _nations(spark, sf_dir)]).digest()
    return spark.createDataFrame([(d,)], "digest string")


_FAULTS = (
    ("unknown key", "  - {id: a.b, severity: info, message: m, colour: red, regex: {pattern: x}}"), ("dotted parts", "  - {id: Bad, severity: info, message: m, regex: {pattern: x}}"),
    ("linear-time", "  - {id: a.b, severity: info, message: m, regex: {pattern: '(?=x)'}}"), ("exactly one of", "  - {id: a.b, severity: info, message: m}"),
    ("silo name", "  - {id: a.b, severity: info, message: m, boundary: {from: 'a b', deny: [c]}}"), ("lies outside", "  - {id: a.b, severity: info, message: m, coverage: {min: 101}}"),
    ("reserved", "  - {id: metrics.duplicate-block, severity: info, message: m, regex: {pattern: x}}"), ("severity must", "  - {id: a.b, severity: fatal, message: m, regex: {pattern: x}}"),
)


@query(f"WITH {NATIONS} SELECT k, CASE WHEN k % 9 = 8 THEN 'none' ELSE [{', '.join(_q(f) for f, _ in _FAULTS)}][k % 9 + 1] END AS fault FROM nat")
def rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fault(k: int) -> str:
        try:
            loader.load_text("version: 1\nrules:\n" + (_FAULTS[k % 9][1] if k % 9 < 8 else _nation_rule(1, "fine")), f"{k}")
        except loader.RuleError as e:
            return next(m for m, _ in _FAULTS if m in str(e))
        return "none"

    return spark.createDataFrame([(k, fault(k)) for k, _, _ in _nations(spark, sf_dir)], "k long, fault string")


@query(r"SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ['(?='] WHEN 1 THEN ['\1'] WHEN 2 THEN ['(?>'] ELSE [] END AS found FROM part")
def pattern_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns made of part names, with and without constructs that no linear-time engine has; each distinct one is looked at once."""
    kinds = ("(?={})", r"({})\1", "(?>{})", "[(?=]{}", "({})?")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 5).cast("int").alias("kind"))

    @F.udf("array<string>")
    def found(name: str, kind: int) -> list[str]:
        return loader.lint(kinds[kind].format(name))

    distinct = p.select("p_name", "kind").distinct()
    return p.join(distinct.withColumn("found", found("p_name", "kind")), ["p_name", "kind"]).select("p_partkey", "found")


@query(f"WITH {NATIONS} SELECT 'secrets.' || lower(replace(n, '_', '-')) AS rule_id, CASE WHEN k % 3 = 0 THEN 'left out' ELSE n END AS outcome FROM nat")
def pack_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TOML pack turned into YAML rules; patterns with look-around are left out."""
    nations = _nations(spark, sf_dir)
    pack = "".join(f"[[rules]]\nid = \"{n.lower().replace('_', '-')}\"\ndescription = \"{n}\"\nregex = '''{'(?=x)' if k % 3 == 0 else ''}{n}([0-9]+)'''\nkeywords = [\"{n.lower()}\"]\n" for k, n, _ in nations)
    text, skipped = convert(pack)
    rows = [(r.id, r.message) for r in loader.load_text(text, "pack").rules] + [(f"secrets.{n}", "left out") for n, _ in skipped]
    return spark.createDataFrame(rows, "rule_id string, outcome string")


@query("SELECT * FROM (VALUES ('boundary without silos', true), ('gate by silo without silos', true), ('coverage without a report', true), ('plain rules', false)) v(case_, refused)")
def setup_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = {
        "boundary without silos": Rule(id="a.b", severity="info", message="m", kind="boundary", source="x", deny=("y",)), "gate by silo without silos": Rule(id="a.b", severity="info", message="m", kind="duplication", limit=1.0, scope="silo"),
        "coverage without a report": Rule(id="a.b", severity="info", message="m", kind="coverage", limit=1.0), "plain rules": rules().rules[0],
    }

    def refused(rule: Rule) -> bool:
        try:
            scan.Scanner(spark, loader.RuleSet([rule]))._setup(None)
        except scan.SetupError:
            return True
        return False

    return spark.createDataFrame([(name, refused(r)) for name, r in some.items()], "case_ string, refused boolean")


# --- coverage reports

@query("SELECT 'lib/' || l_suppkey || '.py' AS path, count(DISTINCT l_partkey)::BIGINT AS lines_total, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END)::BIGINT AS lines_covered FROM lineitem GROUP BY l_suppkey")
def coverage_cobertura(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines written as Cobertura's XML by the executors, read again: the lines of a class count, those of its methods don't."""
    root = _folder(spark)
    line = F.concat(F.lit('<line number="'), F.col("l_partkey").cast("string"), F.lit('" hits="'), F.when(F.col("l_returnflag") == "R", "3").otherwise("0"), F.lit('"/>'))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.collect_list(line), "").alias("lines"))
    name = F.concat(F.lit("lib\\"), F.col("l_suppkey").cast("string"), F.lit(".py"))
    text = F.concat(F.lit('<class filename="'), name, F.lit('"><methods><method><lines><line number="0" hits="9"/></lines></method></methods><lines>'), F.col("lines"), F.lit("</lines></class>"))

    def wrapped(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(["<coverage><packages><package><classes>"])], names=["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</classes></package></packages></coverage>"])], names=["value"])

    rows.select(text.alias("value")).mapInArrow(wrapped, "value string").write.text(f"file://{root}/xml")
    return reports.read_cobertura(spark, f"file://{root}/xml")


@query("SELECT 'n' || c_nationkey || '/' || c_custkey || '.c' AS path, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_custkey % 40 END::BIGINT AS lines_total, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE least(c_custkey % 40, c_custkey % 50) END::BIGINT AS lines_covered FROM customer")
def coverage_lcov_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with totals of their own, which win over the lines, and hits that are at most what was found."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/"), k.cast("string"), F.lit(".c")).alias("path"), k)
    totals = F.array(F.concat(F.lit("LF:"), (k % 40).cast("string")), F.concat(F.lit("LH:"), (k % 50).cast("string")))
    text = F.concat(F.array(F.concat(F.lit("SF:"), "path"), F.lit("DA:7,2")), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(totals), F.array(F.lit("end_of_record")))
    return reports.lcov(c.select(text.alias("lines")))


@query("SELECT * FROM (VALUES ('lcov', 'lcov'), ('cobertura', 'cobertura'), ('other root', 'refused'), ('no XML', 'refused')) v(case_, format)")
def coverage_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def told(text: str) -> str:
        try:
            return reports.coverage_format(text)
        except reports.ReportError:
            return "refused"

    texts = {"lcov": "TN:\nSF:a\nend_of_record\n", "cobertura": "<?xml version='1.0'?><coverage/>", "other root": "<report/>", "no XML": "SF"}
    return spark.createDataFrame([(k, told(t)) for k, t in texts.items()], "case_ string, format string")


@query(f"""WITH {_ROLLED}, {_SCANNED}, low AS (SELECT count(*) AS n FROM res WHERE 100.0 * lines_covered / lines_total < 35), {findings_sql()} SELECT (SELECT n FROM low)::BIGINT AS coverage_findings, count(*)::BIGINT AS others FROM found""")
def coverage_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage findings are told from others by their text."""
    rule = Rule(id="gates.coverage", severity="warning", message="Too little is covered.", kind="coverage", limit=35.0)
    every = coverage.gate(rule, _resolved(spark, sf_dir)).unionByName(_findings(spark, sf_dir))
    told = X.is_coverage_text("matched")
    return every.agg(F.count_if(told).alias("coverage_findings"), F.count_if(~told).alias("others"))


@query(f"""WITH {_ROLLED}, {_SCANNED}, low AS (SELECT path, lines_covered || '/' || lines_total || ' lines (' || printf('%.1f', 100.0 * lines_covered / lines_total) || '%)' AS matched, unnest(['gates.a', 'gates.b']) AS rule_id FROM res WHERE 100.0 * lines_covered / lines_total < 35)
    SELECT row_number() OVER (ORDER BY path, rule_id, matched) AS place, path, rule_id, matched FROM low""")
def gate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of gates go by path, rule and text."""
    from pyspark.sql import Window

    some = [coverage.gate(Rule(id=f"gates.{x}", severity="warning", message="m", kind="coverage", limit=35.0), _resolved(spark, sf_dir)) for x in "ba"]
    w = Window.orderBy("path", "rule_id", "matched")
    return some[0].unionByName(some[1]).select(F.row_number().over(w).cast("long").alias("place"), "path", "rule_id", "matched")


# --- baselines, reports and manifests as files

@query(f"WITH {findings_sql()} SELECT row_number() OVER (ORDER BY fingerprint, path, rule_id) AS place, fingerprint, rule_id, path FROM found WHERE severity = 'error'")
def baseline_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in order in one replacement, and read again."""
    import json

    path = _folder(spark) / "baseline.json"
    sinks.write_baseline(_findings(spark, sf_dir).where("severity = 'error'"), path)
    place = {(e["fingerprint"], e["rule_id"], e["path"]): k + 1 for k, e in enumerate(json.loads(path.read_text())["entries"])}
    rows = [(place[tuple(r)], *r) for r in reports.read_baseline(spark, str(path), True).collect()]
    return spark.createDataFrame(rows, "place long, fingerprint string, rule_id string, path string")


@query(f"WITH {findings_sql()} SELECT rule_id, path, line, \"column\", CASE WHEN rule_id = 'text.hex-token' THEN '<redacted>' ELSE matched END AS matched, fingerprint, 'new' AS status FROM found WHERE severity <> 'info'")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report of all but infos, written and read again by executors."""
    import functools

    report = scan.Scanner(spark, rules()).scan(_files(spark, sf_dir))
    path = _folder(spark) / "report.json"
    where = sinks.write_json_report(report, path, least="warning")
    parts = [reports.findings_of(sinks.json_entries(spark, path, where[k]), status) for k, status in (("findings", "new"), ("baselined", "baselined"), ("suppressed", "suppressed"))]
    return functools.reduce(DataFrame.unionByName, parts).select("rule_id", "path", "line", "column", "matched", "fingerprint", "status")


@query(f"WITH {NATIONS} SELECT r || '/' || n AS path, k::BIGINT AS line, CASE k % 3 WHEN 0 THEN [] WHEN 1 THEN ['a.' || k] ELSE ['a.' || k, 'b.' || k] END AS expect FROM nat")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) / "manifest.tsv"
    _put(path.parent, path.name, "# path\tline\texpect\twhy\n" + "".join(f"{r}/{n}\t{k}\t{('NONE', f'a.{k}', f'a.{k}|b.{k}')[k % 3]}\tbecause\n" for k, n, r in _nations(spark, sf_dir)))
    return reports.read_manifest(spark, str(path)).select("path", "line", "expect")


@query("""WITH s AS (SELECT 's' || s_suppkey AS path, row_number() OVER (ORDER BY 's' || s_suppkey) AS k, count(*) OVER () AS n FROM supplier)
    SELECT k, 'skipped ' || path || ': not valid UTF-8' AS text FROM s WHERE k <= 10 UNION ALL SELECT DISTINCT 11, '... and ' || (n - 10) || ' more' FROM s WHERE n > 10""")
def skip_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.skip_notes(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.lit(sources.INVALID).alias("reason")))


@query("SELECT * FROM (VALUES (0, 0, NULL), (1, 0, 'ignored 1 file'), (2, 0, 'ignored 2 files'), (0, 1, 'ignored 1 directory'), (3, 2, 'ignored 3 files and 2 directories')) v(files, directories, said)")
def ignored_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f, d, sources.ignored_summary(f, d)) for f, d in ((0, 0), (1, 0), (2, 0), (0, 1), (3, 2))], "files int, directories int, said string")


@query("SELECT DISTINCT l_quantity::INT || '.' || l_linenumber AS version, l_quantity::INT > 25 OR (l_quantity::INT = 25 AND l_linenumber >= 3) AS enough FROM lineitem UNION ALL SELECT 'x', false")
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.concat_ws(".", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")).alias("version")).distinct()
    return v.union(spark.createDataFrame([("x",)], "version string")).select("version", X.version_at_least("version", 25, 3).alias("enough"))


# --- parity and self-tests

_BUCKETS = f"""{findings_sql()}, a AS (SELECT path, line, list_sort(list(DISTINCT rule_id)) AS x FROM found WHERE severity <> 'info' GROUP BY ALL), b AS (SELECT path, line, list_sort(list(DISTINCT rule_id)) AS y FROM found WHERE rule_id <> 'text.email' GROUP BY ALL),
    p AS (SELECT path, line, x, y, CASE WHEN y IS NULL THEN 'only-ours' WHEN x IS NULL THEN 'only-theirs' WHEN list_has_any(x, y) THEN 'same' ELSE 'differing' END AS bucket FROM a FULL JOIN b USING (path, line))"""


def _parity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = _findings(spark, sf_dir)
    ours, theirs = sinks.rules_per_line(found.where("severity <> 'info'")), sinks.rules_per_line(found.where("rule_id <> 'text.email'"))
    return sinks.parity(ours, theirs), ours, theirs


@query(f"WITH {_BUCKETS} SELECT v AS bucket, (SELECT count(*) FROM p WHERE bucket = v) AS places FROM (VALUES ('same'), ('differing'), ('only-ours'), ('only-theirs')) t(v)")
def parity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.parity_counts(_parity(spark, sf_dir)[0])


@query(f"WITH {_BUCKETS} SELECT path, line, path || chr(9) || line || chr(9) || coalesce(array_to_string(y, ';'), '-') || chr(9) || coalesce(array_to_string(x, ';'), '-') || chr(9) || bucket AS text FROM p WHERE bucket <> 'same'")
def parity_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.parity_tsv(*_parity(spark, sf_dir))


_OUTCOMES = """o AS (SELECT source AS family, doc_id, contains(text, 'token = "') AND regexp_matches(split_part(text, chr(10), 1), 'token = "[0-9a-f]{40}"') AS hit FROM documents WHERE text <> '')"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document announces a token in its first line."""
    from .rulesets.loader import RuleSet

    f = _files(spark, sf_dir).where("content <> ''").select("path", F.concat(F.lit("auditlake-expect: text.hex-token\n"), F.substring_index("content", "\n", 1)).alias("content"))
    return harness.run(f, RuleSet([r for r in rules().rules if r.id == "text.hex-token"]))


@query(f"WITH {_OUTCOMES} SELECT count_if(hit)::BIGINT AS matched, count_if(NOT hit)::BIGINT AS missing, 0::BIGINT AS unexpected FROM o")
def harness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.summary(_outcomes(spark, sf_dir))


@query(f"WITH {_OUTCOMES} SELECT family, count(*)::BIGINT AS expected, count_if(hit) / count(*) AS recall FROM o GROUP BY family")
def recall_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.recall_by_family(_outcomes(spark, sf_dir))


# --- rules' gates

@query(f"WITH {findings_sql([r for r in rules().rules if r.id == 'text.email'])} SELECT path, line, matched FROM found WHERE NOT contains(path, '/de/') AND NOT starts_with(path, 'src0/')")
def allowed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secret rule whose allowlist names paths."""
    r = next(r for r in rules().rules if r.id == "text.email")
    return matching.findings(_files(spark, sf_dir), [replace(r, kind="secret", keywords=("@",), allow_paths=("*/de/*", "src0/**"))]).select("path", "line", "matched")


@query("""SELECT o_orderkey, o_custkey::VARCHAR AS matched FROM orders WHERE o_orderstatus = 'O'""")
def optional_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group that takes no part in a match reports nothing."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("order"), F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("="), F.col("o_custkey").cast("string"))).otherwise(""), F.lit(";"))
    f = o.select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), text.alias("content"))
    rule = Rule(id="a.b", severity="info", message="m", kind="regex", pattern=r"order(?:=(\d+))?;", group=1)
    return matching.findings(f, [rule]).select(F.substring_index("path", "/", -1).cast("long").alias("o_orderkey"), "matched")


def _sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as source files: Python or JavaScript, small or large, some with a fault."""
    k = F.col("c_custkey")
    end = F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".js").otherwise("")
    body = F.concat(F.when(k % 3 == 2, "#!/usr/bin/env python\n").otherwise(""), F.lit("import os\n\n\nclass C(Base):\n    def run(self):\n        return eval(os.name)  # "), F.repeat(F.lit("x"), (k % 7 * 40).cast("int")), F.lit("\n"), F.when(k % 10 == 9, "def (:\n").otherwise(""))
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.concat(F.lit("src/"), k.cast("string"), end).alias("path"), body.alias("content"))


_EVAL = Rule(id="code.eval", severity="error", message="eval", kind="ast", languages=("python",), queries=(("python", '(call function: (identifier) @_f (#eq? @_f "eval") arguments: (argument_list (_) @report))'),))
_SOURCES = "src AS (SELECT c_custkey AS k, 'src/' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '' END AS path, 75 + CASE WHEN c_custkey % 3 = 2 THEN 22 ELSE 0 END + (c_custkey % 7) * 40 + CASE WHEN c_custkey % 10 = 9 THEN 7 ELSE 0 END AS bytes FROM customer)"


@query(f"WITH {_SOURCES} SELECT path, CASE WHEN k % 3 = 2 THEN 7 ELSE 6 END::BIGINT AS line, 21::BIGINT AS \"column\", 'os.name' AS matched FROM src WHERE k % 3 <> 1")
def ast_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension and by shebang; another language's files give nothing, and those with a faulty line what the others hold."""
    return syntax.findings(_sources_of(spark, sf_dir), [_EVAL]).select("path", "line", "column", "matched")


_CALLS = {  # extension, what stands before a call and behind it, and where the call is
    "javascript": (".js", "const m = require('m');\nfunction f(a) {\n  return a.b(", ");\n}\n", 3, 14),
    "typescript": (".ts", "class C<T> {\n  m(a: T): string {\n    return `${", "}`;\n  }\n}\n", 3, 15),
    "go": (".go", "package p\n\nfunc f() {\n\tx := ", "\n\tuse(x)\n}\n", 4, 7),
    "java": (".java", "class C {\n  int f() {\n    return ", ";\n  }\n}\n", 3, 12),
    "rust": (".rs", "impl C {\n    fn f<'a>(&'a self) -> Option<u8> {\n        let x: Vec<u8> = ", ".ok()?;\n        None\n    }\n}\n", 3, 26),
}
_CALLED = '(call_expression function: (identifier) @_f (#eq? @_f "eval")) @report'


@query(
    "SELECT o_orderkey || e AS path, line, c AS \"column\", 'eval(' || o_custkey || ')' AS matched FROM orders JOIN (VALUES "
    + ", ".join(f"({k}, '{e}', {line}::BIGINT, {c}::BIGINT)" for k, (e, _, _, line, c) in enumerate(_CALLS.values()))
    + ") v(k, e, line, c) ON o_orderkey % 5 = k WHERE o_orderstatus = 'O'"
)
def ast_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule with queries for five languages, over orders as their source files."""
    k, key = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    call = F.concat(F.when(F.col("o_orderstatus") == "O", "eval(").otherwise("save("), F.col("o_custkey").cast("string"), F.lit(")"))
    path, content = F.lit(None), F.lit(None)
    for n, (end, head, tail, _, _) in enumerate(_CALLS.values()):
        path, content = F.when(k == n, F.concat(key, F.lit(end))).otherwise(path), F.when(k == n, F.concat(F.lit(head), call, F.lit(tail))).otherwise(content)
    java = '(method_invocation name: (identifier) @_f (#eq? @_f "eval")) @report'
    rule = Rule(id="code.eval", severity="error", message="eval", kind="ast", languages=tuple(_CALLS), queries=tuple((x, java if x == "java" else _CALLED) for x in _CALLS))
    return syntax.findings(table(spark, sf_dir, "orders").select(path.alias("path"), content.alias("content")), [rule]).select("path", "line", "column", "matched")


@query(f"WITH {_SOURCES} SELECT path, 'larger than the parse limit of 200 bytes' AS reason, row_number() OVER (ORDER BY path) AS place FROM src WHERE k % 3 <> 1 AND bytes > 200")
def parse_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a syntax rule would need parsed but for their size, in order of path."""
    from pyspark.sql import Window

    big = syntax.oversized(_sources_of(spark, sf_dir), [_EVAL], 200)
    return big.select("path", "reason", F.row_number().over(Window.orderBy("path")).cast("long").alias("place"))


@query(f"WITH {_SOURCES} SELECT path, name, kind, line FROM src, (VALUES ('C', 'class', 4), ('run', 'function', 5)) v(name, kind, l), LATERAL (SELECT (l + CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS line) WHERE k % 3 <> 1")
def source_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.declaration_table(_sources_of(spark, sf_dir).where("path NOT LIKE '%.js'")).select("path", "name", "kind", "line")


@query(f"WITH {findings_sql()} SELECT path, row_number() OVER (PARTITION BY path ORDER BY line, \"column\", rule_id) AS place, rule_id, matched FROM found")
def engine_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the engine over batches gives a file's findings: by offset, then by the rules' order."""
    some = sorted(rules().rules, key=lambda r: r.id)
    f = _files(spark, sf_dir)

    @F.udf("array<struct<place: bigint, rule_id: string, matched: string>>")
    def found(path: str, content: str) -> list[tuple]:
        return [(k + 1, x[0], x[7]) for k, x in enumerate(matching.file_findings(some, path, None, content))]

    return f.select("path", F.explode(found("path", "content")).alias("x")).select("path", "x.*")


@query(f"WITH {FILES} SELECT path, 2::BIGINT AS line, 'a.b' AS rule_id FROM files UNION ALL SELECT path, 1, 'c.d' FROM files UNION ALL SELECT path, 1, 'e-f' FROM files")
def next_line_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).select("path", F.concat(F.lit("# auditlake-ignore-line: c.d, e-f and more // auditlake-ignore: a.b\n"), "content").alias("content"))
    return markers.suppressions(f)


@query(f"WITH {FILES} SELECT path, 'slash' AS kind, 1 + len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(regexp_replace(x, '//.*', ''), '\\S')))::BIGINT AS code_lines FROM files UNION ALL SELECT path, 'ruby', len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*#')))::BIGINT FROM files")
def block_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document twice, first inside of a block comment and then as code."""
    f = _files(spark, sf_dir)
    slash = F.concat(F.lit("/* a\n"), F.replace("content", F.lit("*/"), F.lit("")), F.lit("\n*/ let x = 1; /* b */\n"), "content")
    ruby = F.concat(F.lit("=begin\n"), "content", F.lit("\n=end\n"), "content")
    return f.select("path", F.lit("slash").alias("kind"), languages.code_lines(slash, F.lit("rust")).alias("code_lines")).union(f.select("path", F.lit("ruby"), languages.code_lines(ruby, F.lit("ruby"))))


# --- paths and imports

@query("SELECT page_id, 'sub/dir/' || url AS path, CASE WHEN strpos(url, '/') > 1 THEN split_part(url, '/', 1) ELSE 'core' END AS family, regexp_matches(url, '(^|/)12$') AS ends FROM pages")
def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", paths.anchored("/sub/dir/", "url").alias("path"), paths.family("url").alias("family"), paths.has_suffix("url", F.lit("12")).alias("ends"))


def _import_rows(d: DataFrame, language: str, raw) -> DataFrame:
    one = F.lit(1).cast("long")
    return d.select("path", F.lit(language).alias("language"), F.lit(0).cast("long").alias("position"), raw.alias("raw"), one.alias("line"), one.alias("column"), one.alias("column_utf16"))


@query("SELECT 'svc/n' || n || '/main.go' AS path, 'svc/n' || n || '/pkg' || k || '/a.go' AS target FROM (SELECT c_nationkey AS n, c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'svc/n' || n || '/main.go', 'svc/n' || n || '/pkg' || k || '/b.go' FROM (SELECT c_nationkey AS n, c_custkey AS k FROM customer WHERE c_custkey % 2 = 1)")
def go_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules named in go.mod files; a package's first file stands in for its folder."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("n"), F.col("c_custkey").alias("k"))
    mods = c.select("n").distinct().select(F.concat(F.lit("svc/n"), "n", F.lit("/go.mod")).alias("path"), F.concat(F.lit("// x\nmodule example.org/m"), "n", F.lit("\n\ngo 1.22\n")).alias("content"))
    pkg = F.concat(F.lit("svc/n"), "n", F.lit("/pkg"), F.col("k").cast("string"))
    first = c.select(F.explode(F.array(F.concat(pkg, F.when(F.col("k") % 2 == 0, "/a.go").otherwise("/b.go")), F.concat(pkg, F.lit("/c.go")), F.concat(pkg, F.lit("/x.txt")))).alias("path"))
    imports = c.select(F.concat(F.lit("svc/n"), "n", F.lit("/main.go")).alias("path"), "n", "k")
    rows = _import_rows(imports, "go", F.concat(F.lit("example.org/m"), "n", F.lit("/pkg"), F.col("k").cast("string"))).withColumn("position", F.xxhash64("raw"))
    return boundary.resolve(rows, first.union(mods.select("path")), modules=boundary.go_modules(mods)).select("path", "target")


@query("SELECT 'app/m' || c_custkey || '.py' AS path, CASE WHEN c_custkey % 2 = 0 THEN 'lib/pkg/p' || c_custkey || '.py' ELSE 'app/q' || c_custkey || '/__init__.py' END AS target FROM customer")
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute imports start at the source roots, relative ones at the file's folder."""
    k = F.col("c_custkey").cast("string")
    even = F.col("c_custkey") % 2 == 0
    c = table(spark, sf_dir, "customer")
    nodes = c.select(F.when(even, F.concat(F.lit("lib/pkg/p"), k, F.lit(".py"))).otherwise(F.concat(F.lit("app/q"), k, F.lit("/__init__.py"))).alias("path"))
    rows = _import_rows(c.withColumn("path", F.concat(F.lit("app/m"), k, F.lit(".py"))), "python", F.when(even, F.concat(F.lit("pkg.p"), k)).otherwise(F.concat(F.lit(".q"), k)))
    return boundary.resolve(rows, nodes, ["lib"]).select("path", "target")


@query("SELECT 'core/src/m' || c_custkey || '/mod.rs' AS path, CASE c_custkey % 3 WHEN 0 THEN 'core/src/a.rs' WHEN 1 THEN 'core/src/m' || c_custkey || '/b.rs' ELSE 'core/src/m0.rs' END AS target FROM customer")
def rust_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``crate``, ``self`` and ``super``, whose last parts may be items rather than files."""
    k = F.col("c_custkey")
    path = F.concat(F.lit("core/src/m"), k.cast("string"), F.lit("/mod.rs"))
    c = table(spark, sf_dir, "customer").withColumn("path", path)
    nodes = c.where(k % 3 == 1).select(F.concat(F.lit("core/src/m"), k.cast("string"), F.lit("/b.rs")).alias("path")).union(spark.createDataFrame([("core/src/a.rs",), ("core/src/m0.rs",)], "path string"))
    return boundary.resolve(_import_rows(c, "rust", F.when(k % 3 == 0, "crate::a::Item").when(k % 3 == 1, "self::b::{X, Y}").otherwise("super::m0")), nodes).select("path", "target")


@query(f"WITH {NATIONS} SELECT 'm' || k AS folder, 'example.org/' || lower(n) AS module FROM nat")
def go_mod_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f"m{k}/go.mod", f"// module no\n  module \"example.org/{n.lower()}\"\n") for k, n, _ in _nations(spark, sf_dir)] + [("m/go.mod", "go 1.22"), ("x/a.go", "module x")]
    return boundary.go_modules(spark.createDataFrame(rows, "path string, content string"))


# --- dashboards

@query("SELECT o_orderkey, CASE WHEN o_custkey % 20 > 0 THEN least(1.0, o_orderkey % 30 / (o_custkey % 20)) ELSE 0.0 END::DOUBLE AS ratio FROM orders")
def progress_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", progress.ratio(F.col("o_orderkey") % 30, F.col("o_custkey") % 20).alias("ratio"))


@query("SELECT doc_id, list_sort(CASE WHEN lang = 'en' THEN [source] ELSE [source, lang, 'en'] END) AS chosen FROM documents")
def toggled_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", progress.toggled(F.array("source", "lang"), F.lit("en")).alias("chosen"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE least(20, greatest(1, round((o_custkey % 10) * 20 / 9.0))) END::INT AS cells FROM orders")
def bar_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", views.bar_cells(F.col("o_custkey") % 10, F.lit(9), 20).alias("cells"))


@query(f"""WITH {ROWS}, n AS (SELECT CASE WHEN {_DIR} IN ('src1', 'src2') THEN {_DIR} ELSE '(unassigned)' END AS silo, severity FROM rows_), l AS (SELECT CASE WHEN {_DIR} IN ('src1', 'src2') THEN {_DIR} ELSE '(unassigned)' END AS silo,
    sum(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\\S'))))::BIGINT AS lines FROM files GROUP BY 1), s AS (SELECT unnest(['(unassigned)', 'src1', 'src2', 'spare']) AS silo)
    SELECT s.silo, coalesce(count_if(severity = 'info'), 0)::BIGINT AS info, coalesce(count_if(severity = 'warning'), 0)::BIGINT AS warning, coalesce(count_if(severity = 'error'), 0)::BIGINT AS error, coalesce(any_value(lines), 0)::BIGINT AS lines FROM s LEFT JOIN n USING (silo) LEFT JOIN l ON l.silo = s.silo GROUP BY s.silo""")
def declared_silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of declared silos, one of which has no files, and of what belongs to none."""
    from .queries import _marked

    silos = _silos(spark, sf_dir).where("silo IN ('src1', 'src2')")
    metrics = _marked(spark, sf_dir).select("path", X.count_lines("content").alias("lines"), F.lit(0).alias("duplicated_lines"))
    return views.silo_cards(_rows(spark, sf_dir), metrics, silos, ["src1", "src2", "spare"]).drop("duplication")


@query(f"WITH {ROWS} SELECT {_ALL}, status FROM rows_ WHERE {_DIR} = 'src1'")
def silo_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.silo_drill(_rows(spark, sf_dir), _silos(spark, sf_dir), "src1")


@query(f"WITH {ROWS} SELECT card, count(r.rule_id) AS rows FROM (VALUES ('errors'), ('warnings'), ('infos'), ('debt'), ('new')) c(card) LEFT JOIN rows_ r ON CASE card WHEN 'errors' THEN severity = 'error' WHEN 'warnings' THEN severity = 'warning' WHEN 'infos' THEN severity = 'info' WHEN 'debt' THEN status <> 'new' ELSE status = 'new' END GROUP BY card")
def card_drills(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .session import checkpointed

    rows, out = checkpointed(_rows(spark, sf_dir)), None
    for card in ("errors", "warnings", "infos", "debt", "new"):
        part = views.filtered(rows, **views.drill(card)).agg(F.lit(card).alias("card"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {findings_sql()} SELECT 'rule code.rb: no parser for ruby, so its queries for these find nothing' AS text, (SELECT count(*) FROM found) AS findings")
def scan_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with a rule that can't be evaluated warns of it and reports the others' findings."""
    ruby = Rule(id="code.rb", severity="error", message="m", kind="ast", languages=("ruby",), queries=(("ruby", "(call) @report"),))
    report = scan.Scanner(spark, loader.RuleSet([*rules().rules, ruby], rules().sources)).scan(_files(spark, sf_dir))
    return report.findings.agg(F.lit("\n".join(report.warnings)).alias("text"), F.count(F.lit(1)).alias("findings"))


@query(f"WITH {findings_sql()} SELECT fail_on, CASE WHEN (SELECT count(*) FROM found WHERE ({_RANK}) >= k) > 0 THEN 1 ELSE 0 END AS status FROM (VALUES ('info', 0), ('warning', 1), ('error', 2)) v(fail_on, k)")
def exit_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = scan.Scanner(spark, rules()).scan(_files(spark, sf_dir))
    return spark.createDataFrame([(at, sinks.exit_status(report, at)) for at in ("info", "warning", "error")], "fail_on string, status int")


@query(f"WITH {MARKED} SELECT * FROM (VALUES (0, true), (40, true), (400, false)) v(days_ago, kept)")
def cache_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the incremental cache written so many days ago, pruned at 60 days."""
    from datetime import timedelta

    from .streaming.incremental import CACHE, Cache

    store = Cache(spark, str(_folder(spark)), "s")
    days = (0, 40, 400)
    for n in days:
        row = spark.createDataFrame([(f"k{n}", [], "t", None)], CACHE).drop("day")
        row.write.parquet(f"{store.folder}/day={(date.today() - timedelta(days=n)).isoformat()}/part=0")
    store.prune(60)
    left = {r["key"] for r in store.read().collect()}
    return spark.createDataFrame([(n, f"k{n}" in left) for n in days], "days_ago int, kept boolean")


@query(f"WITH {findings_sql()} SELECT {_ALL} FROM found")
def cached_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of English documents fills the cache, which is written and read; a scan of all takes theirs from it."""
    from .streaming import incremental

    store, f = incremental.Cache(spark, f"{_folder(spark)}/cache", "s"), _files(spark, sf_dir)
    store.write(incremental.scan_batch(f.where(F.contains("path", F.lit("/en/"))), rules(), salt="s")[1], "0")
    return incremental.scan(f, rules(), store, "1")


@query(f"WITH {ROWS} SELECT {_ALL}, CASE status WHEN 'baselined' THEN 'new' ELSE status END AS status FROM rows_")
def streamed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, scanned by batch with their markers and the cache."""
    from .queries import MARK
    from .streaming import incremental

    root = _folder(spark)
    # a pattern, as streams take a plain path for a folder; the table may be a file or a folder of parts
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/{{documents.parquet}}")
    stream = sources.from_documents(docs).withColumn("content", F.replace("content", F.lit("Licensed under"), F.lit(f"/* {MARK} Licensed under")))
    incremental.watch_files(stream, rules(), f"{root}/out", f"{root}/state", incremental.Cache(spark, f"{root}/cache", "s")).awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*FINDING_COLUMNS, "status")


@query(f"WITH {findings_sql()} SELECT 'first' AS event, count(*)::BIGINT AS files_total, 0::BIGINT AS files_done, 0::BIGINT AS findings, 0.0::DOUBLE AS ratio FROM files UNION ALL SELECT 'last', count(*), count(*), (SELECT count(*) FROM found), 1.0 FROM files")
def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said: list[progress.Progress] = []
    progress.scan_with_progress(scan.Scanner(spark, rules()), _files(spark, sf_dir), said.append)
    rows = [(name, p.files_total, p.files_done, p.findings, p.ratio) for name, p in (("first", said[0]), ("last", said[-1]))]
    return spark.createDataFrame(rows, "event string, files_total long, files_done long, findings long, ratio double")


def _verdicts(rows: DataFrame) -> DataFrame:
    chosen = F.when(F.col("rule_id") == "text.hex-token", "ignore").when(F.col("rule_id") == "text.email", "baseline").otherwise("next")
    return ratchet.checked(rows.select("fingerprint", chosen.alias("verdict")))


@query(f"""WITH {findings_sql()}, m AS (SELECT path, list(DISTINCT line) AS ls FROM found WHERE rule_id = 'text.hex-token' GROUP BY path)
    SELECT path, array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: CASE WHEN list_contains(ls, i) THEN x || ' # auditlake-ignore-line: text.hex-token' ELSE x END), chr(10)) AS content FROM files JOIN m USING (path)""")
def ratchet_silenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the markers that verdicts put there."""
    rows = _findings(spark, sf_dir).withColumn("status", F.lit("new"))
    return ratchet.silence(_files(spark, sf_dir), rows, _verdicts(rows))


@query(f"WITH {ROWS} SELECT DISTINCT fingerprint, rule_id, path FROM rows_ WHERE status = 'baselined' OR (status = 'new' AND rule_id = 'text.email')")
def ratchet_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import baseline
    from .session import checkpointed

    rows = checkpointed(_rows(spark, sf_dir))
    return ratchet.accept(baseline.entries(rows.where("status = 'baselined'")), rows, _verdicts(rows))


@query(f"WITH {ROWS} SELECT {_ALL}, status FROM rows_ WHERE status = 'new' AND rule_id NOT IN ('text.email', 'text.hex-token')")
def ratchet_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .session import checkpointed

    rows = checkpointed(_rows(spark, sf_dir))
    return ratchet.remaining(rows, _verdicts(rows))
