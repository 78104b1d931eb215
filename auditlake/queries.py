"""Queries over the driver's tables, and the same in DuckDB's SQL.

Documents are the files of a scan (``source/lang/id.txt``) and their sources its silos; every query runs over whole
tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import languages, paths
from .functions import text as X
from .model import FINDING_COLUMNS
from .operators import baseline, boundary, coverage, duplication, facts, markers, matching, syntax
from .plans import scan, views
from .rulesets.loader import Rule, RuleSet, default_rules, load_text
from .session import by_size, checkpointed, prepare, table
from .sinks import reports as sinks
from .sources import files as sources
from .sources import reports
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_LATER: list[tuple[str, Callable[[], str]]] = []

RULES = """
version: 1
rules:
  - {id: text.license-line, severity: info, message: A license is named., regex: {pattern: 'Licensed under the [A-Za-z0-9 ,.]+'}}
  - {id: text.email, severity: warning, message: An address., regex: {pattern: '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'}}
  - {id: text.hex-token, severity: error, message: A token., regex: {pattern: 'token = "[0-9a-f]{40}"', redact: true}}
  - {id: text.shouting, severity: info, message: Loud words., regex: {pattern: '[A-Z]{3,}[!.,]*!!'}}
"""
SECRET = "secrets.generic-secret-assignment"
MARK = "auditlake-ignore-line: text.license-line, */"


def rules() -> RuleSet:
    return load_text(RULES, "queries")


def query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL, or with a function that gives the SQL once all of this module is there."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if callable(sql):
            _LATER.append((f.__name__, sql))
        elif sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_documents(table(spark, sf_dir, "documents"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, with a marker in front of every named license."""
    return _files(spark, sf_dir).withColumn("content", F.replace("content", F.lit("Licensed under"), F.lit(f"/* {MARK} Licensed under")))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.findings(_files(spark, sf_dir), rules().rules)


def _silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", paths.top_dir("path").alias("silo"))


def _accepted(found: DataFrame) -> DataFrame:
    return baseline.entries(found.where(F.contains("path", F.lit("/fr/"))))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with status: suppressed by markers, accepted in French documents, else new."""
    files = _marked(spark, sf_dir)
    found, marks = checkpointed(matching.findings(files, rules().rules)), markers.suppressions(files)
    return scan.with_status(found, marks, _accepted(markers.kept(found, marks)))


# --- building blocks of the SQL

FILES = "files AS (SELECT source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path, text AS content FROM documents)"
MARKED = f"files AS (SELECT source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path, replace(text, 'Licensed under', '/* {MARK} Licensed under') AS content FROM documents)"
_SPACED = r"trim(regexp_replace(matched, '\s+', ' ', 'g'))"


def _q(x: str) -> str:
    return "'{}'".format(x.replace("'", "''"))


def findings_sql(some: list[Rule] | None = None, files: str = FILES) -> str:
    """CTEs that end in ``found``: the findings of whole-match rules."""
    parts = []
    for r in some or rules().rules:
        p = _q(r.pattern)
        parts.append(
            f"SELECT {_q(r.id)} AS rule_id, {_q(r.severity)} AS severity, {_q(r.message)} AS message, path, content, m[i] AS matched, "
            f"(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS off "
            f"FROM (SELECT path, content, regexp_extract_all(content, {p}) AS m, string_split_regex(content, {p}) AS gaps FROM files WHERE regexp_matches(content, {p})), unnest(range(1, len(m) + 1)) AS t(i)"
        )
    return f"""{files}, raw AS ({' UNION ALL '.join(parts)}),
        placed AS (SELECT *, substr(content, 1, off) AS prefix FROM raw),
        tailed AS (SELECT *, regexp_extract(prefix, '[^\\n]*$') AS tail FROM placed),
        counted AS (SELECT *, row_number() OVER (PARTITION BY path, rule_id, {_SPACED} ORDER BY off) - 1 AS occurrence FROM tailed),
        found AS (SELECT rule_id, severity, message, path, (length(prefix) - length(replace(prefix, chr(10), '')) + 1)::BIGINT AS line, (strlen(tail) + 1)::BIGINT AS "column",
            (length(tail) + 1)::BIGINT AS column_utf16, matched, sha256(rule_id || chr(0) || path || chr(0) || {_SPACED} || chr(0) || occurrence::VARCHAR) AS fingerprint FROM counted)"""


MARKS = f"marks AS (SELECT path, i::BIGINT AS line, 'text.license-line' AS rule_id FROM (SELECT path, string_split(content, chr(10)) AS ls FROM files), unnest(range(1, len(ls) + 1)) AS t(i) WHERE contains(ls[i], {_q(MARK)}))"
ROWS = f"""{findings_sql(files=MARKED)}, {MARKS},
    kept AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.path = f.path AND m.line = f.line AND m.rule_id = f.rule_id)),
    accepted AS (SELECT DISTINCT fingerprint FROM kept WHERE contains(path, '/fr/')),
    rows_ AS (SELECT *, CASE WHEN fingerprint IN (SELECT fingerprint FROM accepted) THEN 'baselined' ELSE 'new' END AS status FROM kept
        UNION ALL SELECT *, 'suppressed' FROM found f WHERE EXISTS (SELECT 1 FROM marks m WHERE m.path = f.path AND m.line = f.line AND m.rule_id = f.rule_id))"""
_ALL = ", ".join(f'"{c}"' for c in FINDING_COLUMNS)
_DIR = "CASE WHEN strpos(path, '/') > 1 THEN split_part(path, '/', 1) ELSE '.' END"
_RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 END"


# --- lines and metrics

@query(f"WITH {FILES} SELECT path, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\\S')))::BIGINT AS lines FROM files")
def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", X.count_lines("content").alias("lines"))


@query(f"WITH {FILES} SELECT count(*) AS files, sum(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\\S'))))::BIGINT AS lines FROM files")
def line_metrics_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_metrics(spark, sf_dir).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))


@query(f"WITH {FILES} SELECT path, i::BIGINT AS line, ls[i] AS text FROM (SELECT path, string_split(content, chr(10)) AS ls, content FROM files), unnest(range(1, len(ls) + 1)) AS t(i) WHERE content <> '' AND (i < len(ls) OR ls[i] <> '')")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.numbered_lines(_files(spark, sf_dir))


@query(f"WITH {FILES} SELECT path, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*#')))::BIGINT AS code_lines FROM files")
def code_lines_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", languages.code_lines("content", F.lit("python")).alias("code_lines"))


@query(f"WITH {FILES}, cut AS (SELECT path, string_split(replace(content, '. ', '. // '), chr(10)) AS ls FROM files) SELECT path, len(list_filter(ls, lambda x: regexp_matches(regexp_replace(x, '//.*', ''), '\\S')))::BIGINT AS code_lines FROM cut")
def code_lines_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", languages.code_lines(F.replace("content", F.lit(". "), F.lit(". // ")), F.lit("rust")).alias("code_lines"))


@query("""WITH files AS (SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.Rs' WHEN 'fr' THEN '.tsx' ELSE '' END AS path, CASE WHEN lang = 'es' THEN '#!/usr/bin/env node' || chr(10) ELSE '' END || text AS content, lang FROM documents)
    SELECT path, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'rust' WHEN 'fr' THEN 'typescript' WHEN 'es' THEN 'javascript' END AS language FROM files""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".Rs").when(F.col("lang") == "fr", ".tsx").otherwise("")
    content = F.concat(F.when(F.col("lang") == "es", "#!/usr/bin/env node\n").otherwise(""), "text")
    f = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"), content.alias("content"))
    return f.select("path", languages.detect("path", "content").alias("language"))


# --- findings

@query(f"WITH {findings_sql()} SELECT rule_id, severity, message, path, line, \"column\", matched, fingerprint FROM found")
def regex_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).drop("column_utf16")


@query(f"WITH {findings_sql()} SELECT rule_id, path, line, column_utf16 FROM found")
def regex_findings_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("rule_id", "path", "line", "column_utf16")


@query(f"WITH {findings_sql()} SELECT path, rule_id, fingerprint FROM found")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same findings by way of the Python engine, which has to agree with the native one."""
    return matching.python_findings(_files(spark, sf_dir), rules().rules).select("path", "rule_id", "fingerprint")


@query(f"WITH {findings_sql()} SELECT {_ALL} FROM found WHERE contains(path, '/en/') AND NOT starts_with(path, 'src1')")
def rule_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    some = [replace(r, include=("*/en/*",), exclude=("src1*",)) for r in rules().rules]
    return matching.findings(_files(spark, sf_dir), some)


def _secret() -> Rule:
    return next(r for r in default_rules().rules if r.id == SECRET)


def _secret_sql() -> str:
    r = _secret()
    p, value = _q(r.pattern), "v"
    entropy = f"list_aggregate(string_split({value}, ''), 'entropy')"
    drop = " OR ".join([*(f"regexp_matches({value}, {_q(a)})" for a in r.allow_patterns), *(f"contains(lower({value}), {_q(w)})" for w in r.stopwords)])
    keys = " OR ".join(f"contains(lower(content), {_q(k)})" for k in r.keywords)
    return f"""{FILES}, raw AS (SELECT path, content, m[i] AS whole, vs[i] AS v, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS off
            FROM (SELECT path, content, regexp_extract_all(content, {p}) AS m, regexp_extract_all(content, {p}, 1) AS vs, string_split_regex(content, {p}) AS gaps FROM files WHERE {keys}), unnest(range(1, len(m) + 1)) AS t(i)),
        passed AS (SELECT path, v AS matched, substr(content, 1, off + length(whole) - length(v)) AS prefix FROM raw WHERE {entropy} >= {r.entropy} AND NOT ({drop})),
        counted AS (SELECT *, regexp_extract(prefix, '[^\\n]*$') AS tail, row_number() OVER (PARTITION BY path, matched ORDER BY length(prefix)) - 1 AS occurrence FROM passed)"""


@query(f"""WITH {_secret_sql()} SELECT '{SECRET}' AS rule_id, path, (length(prefix) - length(replace(prefix, chr(10), '')) + 1)::BIGINT AS line, (strlen(tail) + 1)::BIGINT AS "column",
    sha256('{SECRET}' || chr(0) || path || chr(0) || matched || chr(0) || occurrence::VARCHAR) AS fingerprint FROM counted""")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.findings(_files(spark, sf_dir), [_secret()]).select("rule_id", "path", "line", "column", "fingerprint")


def _every_secret_sql() -> str:
    """All rules of the pack, one by one: gates as :func:`matching.spans` has them, positions of the group within its match."""
    parts = []
    for r in default_rules().rules:
        p, g = _q(r.pattern), r.group
        keys = " OR ".join(f"contains(lower(content), {_q(k)})" for k in r.keywords) or "true"
        gates = [f"list_aggregate(string_split(v, ''), 'entropy') >= {r.entropy}"] if r.entropy is not None else []
        gates += [f"NOT regexp_matches(v, {_q(x)})" for x in r.allow_patterns] + [f"NOT contains(lower(v), {_q(w)})" for w in r.stopwords]
        parts.append(
            f"SELECT {_q(r.id)} AS rule_id, {_q(r.severity)} AS severity, {_q(r.message)} AS message, path, content, v AS matched, off + strpos(whole, v) - 1 AS off FROM (SELECT path, content, m[i] AS whole, vs[i] AS v, "
            f"(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS off FROM (SELECT path, content, regexp_extract_all(content, {p}) AS m, "
            f"regexp_extract_all(content, {p}, {g}) AS vs, string_split_regex(content, {p}) AS gaps FROM files WHERE ({keys}) AND regexp_matches(content, {p})), unnest(range(1, len(m) + 1)) AS t(i)) WHERE {' AND '.join(gates) or 'true'}"
        )
    return f"""{FILES}, raw AS ({' UNION ALL '.join(parts)}), placed AS (SELECT *, substr(content, 1, off) AS prefix FROM raw), tailed AS (SELECT *, regexp_extract(prefix, '[^\\n]*$') AS tail FROM placed),
        counted AS (SELECT *, row_number() OVER (PARTITION BY path, rule_id, {_SPACED} ORDER BY off) - 1 AS occurrence FROM tailed),
        found AS (SELECT rule_id, severity, message, path, (length(prefix) - length(replace(prefix, chr(10), '')) + 1)::BIGINT AS line, (strlen(tail) + 1)::BIGINT AS "column", (length(tail) + 1)::BIGINT AS column_utf16, '<redacted>' AS matched,
            sha256(rule_id || chr(0) || path || chr(0) || {_SPACED} || chr(0) || occurrence::VARCHAR) AS fingerprint FROM counted)"""


@query(f"WITH {_every_secret_sql()} SELECT {_ALL} FROM found")
def secret_findings_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.findings(_files(spark, sf_dir), default_rules().rules)
    return sinks.redacted(found, default_rules().redacted())


@query(f"WITH {FILES} SELECT path, ({' OR '.join(f'contains(lower(content), {_q(k)})' for k in _secret().keywords)}) AS candidate FROM files")
def secret_keyword_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", matching.has_keyword(_secret()).alias("candidate"))


@query(r"SELECT doc_id, round(list_aggregate(string_split(regexp_extract(text, '[A-Za-z0-9]+'), ''), 'entropy'), 6) + 0.0 AS entropy FROM documents WHERE regexp_matches(text, '[A-Za-z0-9]+')")
def secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.regexp_extract("text", "[A-Za-z0-9]+", 0)
    return table(spark, sf_dir, "documents").where(word != "").select("doc_id", (F.round(X.entropy(word), 6) + 0.0).alias("entropy"))


@query(f"WITH {findings_sql()} SELECT rule_id, path, line, CASE WHEN rule_id = 'text.hex-token' THEN '<redacted>' ELSE matched END AS matched FROM found")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.redacted(_findings(spark, sf_dir), rules().redacted()).select("rule_id", "path", "line", "matched")


# --- markers and baselines

@query(f"WITH {MARKED}, {MARKS} SELECT DISTINCT path, line, rule_id FROM marks")
def suppression_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.suppressions(_marked(spark, sf_dir))


@query(f"WITH {ROWS} SELECT {_ALL} FROM rows_ WHERE status = 'suppressed'")
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _marked(spark, sf_dir)
    return markers.silenced(matching.findings(f, rules().rules), markers.suppressions(f)).select(*FINDING_COLUMNS)


@query(f"WITH {ROWS} SELECT {_ALL} FROM kept")
def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _marked(spark, sf_dir)
    return markers.kept(matching.findings(f, rules().rules), markers.suppressions(f)).select(*FINDING_COLUMNS)


@query(f"WITH {findings_sql()} SELECT {_ALL} FROM found WHERE fingerprint NOT IN (SELECT fingerprint FROM found WHERE contains(path, '/fr/'))")
def baseline_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    return baseline.new(found, _accepted(found))


@query(f"WITH {findings_sql()} SELECT {_ALL} FROM found WHERE fingerprint IN (SELECT fingerprint FROM found WHERE contains(path, '/fr/'))")
def baseline_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    return baseline.known(found, _accepted(found))


@query(f"WITH {findings_sql()} SELECT DISTINCT fingerprint, rule_id, path FROM found WHERE contains(path, '/fr/') OR severity = 'error'")
def baseline_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    return baseline.upsert(_accepted(found), found.where("severity = 'error'").unionByName(found.where(F.contains("path", F.lit("/fr/")))))


@query(f"""WITH {FILES}, marked AS (SELECT path, i::BIGINT + 1 AS line FROM (SELECT path, string_split(content, chr(10)) AS ls FROM files), unnest(range(1, len(ls) + 1)) AS t(i) WHERE contains(ls[i], 'of'))
    SELECT path, line, 'text.hex-token' AS rule_id FROM marked""")
def expectation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.expectations(_expecting(spark, sf_dir))


def _expecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, in which every line with an "of" announces a token on the next."""
    note = F.transform(F.split("content", "\n", -1), lambda x: F.when(F.contains(x, F.lit("of")), F.concat(x, F.lit(" auditlake-expect: text.hex-token"))).otherwise(x))
    return _files(spark, sf_dir).withColumn("content", F.array_join(note, "\n"))


@query(f"""WITH {findings_sql([r for r in rules().rules if r.id == 'text.hex-token'], "files AS (SELECT source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN contains(x, 'of') THEN x || ' auditlake-expect: text.hex-token' ELSE x END), chr(10)) AS content FROM documents)")},
    ls AS (SELECT path, string_split(content, chr(10)) AS ls FROM files), own AS (SELECT path, i::BIGINT AS line FROM ls, unnest(range(1, len(ls) + 1)) AS t(i) WHERE contains(ls[i], 'auditlake-expect:')),
    e AS (SELECT path, line + 1 AS line, 'text.hex-token' AS rule_id FROM own), a AS (SELECT DISTINCT path, line, rule_id FROM found f WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.path = f.path AND o.line = f.line))
    SELECT path, line, rule_id, 'matched' AS outcome FROM (SELECT * FROM e INTERSECT SELECT * FROM a) UNION ALL SELECT path, line, rule_id, 'missing' FROM (SELECT * FROM e EXCEPT SELECT * FROM a)
    UNION ALL SELECT path, line, rule_id, 'unexpected' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""")
def harness_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import harness

    return harness.run(_expecting(spark, sf_dir), RuleSet([r for r in rules().rules if r.id == "text.hex-token"]))


# --- dashboards

@query(f"WITH {ROWS} SELECT s AS severity, count(r.severity) AS findings FROM (VALUES ('info'), ('warning'), ('error')) v(s) LEFT JOIN rows_ r ON r.severity = s GROUP BY s")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.severity_counts(_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT s AS status, count(r.status) AS findings FROM (VALUES ('new'), ('baselined'), ('suppressed')) v(s) LEFT JOIN rows_ r ON r.status = s GROUP BY s")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.status_counts(_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT count_if(status = 'new')::BIGINT AS new_count, count_if(status = 'baselined')::BIGINT AS baselined_count, count_if(status = 'suppressed')::BIGINT AS suppressed_count FROM rows_")
def status_debt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.debt(_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT rule_id, count(*) AS findings FROM rows_ GROUP BY rule_id ORDER BY findings DESC, rule_id LIMIT 8")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.top_rules(_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT {_DIR} AS dir, count(*) AS findings FROM rows_ GROUP BY 1")
def dir_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dir_counts(_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT {_DIR} AS dir, CASE max({_RANK}) WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'error' END AS worst FROM rows_ GROUP BY 1")
def worst_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.worst_by_dir(_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT {_ALL}, status FROM rows_ WHERE severity IN ('warning', 'error') AND status IN ('new', 'baselined') AND contains(lower(path || chr(10) || rule_id || chr(10) || message), 'src1')")
def dashboard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.filtered(_rows(spark, sf_dir), severities=["warning", "error"], statuses=["new", "baselined"], text="SRC1")


@query(f"WITH {ROWS} SELECT {_ALL}, status FROM rows_ ORDER BY {_RANK} DESC, path, line, \"column\", rule_id")
def triage_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ordered(_rows(spark, sf_dir), "severity")


@query(f"WITH {ROWS} SELECT {_ALL}, status FROM rows_ ORDER BY path, line, \"column\", rule_id")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ordered(_rows(spark, sf_dir))


@query(f"WITH {ROWS}, e AS (SELECT count_if(status = 'new' AND severity = 'error') AS e, count_if(status = 'new' AND severity = 'warning') AS w FROM rows_) SELECT CASE WHEN e > 20 THEN 'E' WHEN e > 5 THEN 'D' WHEN e > 0 THEN 'C' WHEN w > 0 THEN 'B' ELSE 'A' END AS rating FROM e")
def rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.rating(_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT CASE WHEN count_if(status = 'new' AND severity = 'error') = 0 THEN 'PASSED' ELSE 'FAILED' END AS verdict FROM rows_")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.gate(_rows(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.file_metrics(_files(spark, sf_dir))


@query(lambda: f"""WITH RECURSIVE {ROWS}, {_PLAIN}, m AS (SELECT f.path, coalesce(lines, 0) AS lines, coalesce(duplicated_lines, 0) AS dup FROM plain f LEFT JOIN met USING (path) LEFT JOIN dup USING (path)),
    s AS (SELECT {_DIR} AS silo, sum(lines)::BIGINT AS lines, sum(dup) AS dup FROM m GROUP BY 1), c AS (SELECT {_DIR} AS silo, count_if(severity = 'info') AS i, count_if(severity = 'warning') AS w, count_if(severity = 'error') AS e FROM rows_ GROUP BY 1)
    SELECT s.silo, coalesce(i, 0)::BIGINT AS info, coalesce(w, 0)::BIGINT AS warning, coalesce(e, 0)::BIGINT AS error, lines, CASE WHEN lines = 0 THEN 0.0 ELSE dup / lines * 100.0 END::DOUBLE AS duplication FROM s LEFT JOIN c USING (silo)""")
def silo_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.silo_cards(_rows(spark, sf_dir), _metrics(spark, sf_dir), _silos(spark, sf_dir))


@query(lambda: f"""WITH RECURSIVE {ROWS}, {_PLAIN}, {_ROLLED}, {_SCANNED}, low AS (SELECT count(*) AS n FROM res WHERE 100.0 * lines_covered / lines_total < 35), t AS (SELECT sum(lines)::BIGINT AS lines, (SELECT coalesce(sum(duplicated_lines), 0) FROM dup)::BIGINT AS d FROM met)
    SELECT count_if(severity = 'info')::BIGINT AS infos, (count_if(severity = 'warning') + (SELECT n FROM low))::BIGINT AS warnings, count_if(severity = 'error')::BIGINT AS errors, count_if(status <> 'new')::BIGINT AS debt, (SELECT n FROM low)::BIGINT AS coverage_findings,
    any_value(lines) AS lines, any_value(d) AS duplicated_lines, any_value(d / lines * 100.0)::DOUBLE AS duplication_density FROM rows_, t""")
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule(id="gates.coverage", severity="warning", message="Too little is covered.", kind="coverage", limit=35.0)
    low = coverage.gate(rule, _resolved(spark, sf_dir)).withColumn("status", F.lit("new"))
    return views.kpis(_rows(spark, sf_dir).unionByName(low), scan.totals(_metrics(spark, sf_dir)))


@query(f"""WITH {ROWS} SELECT 'severity' AS section, s AS value, count(r.severity) AS findings, s = 'error' AS active FROM (VALUES ('info'), ('warning'), ('error')) v(s) LEFT JOIN rows_ r ON r.severity = s GROUP BY s
    UNION ALL SELECT 'status', s, count(r.status), false FROM (VALUES ('new'), ('baselined'), ('suppressed')) v(s) LEFT JOIN rows_ r ON r.status = s GROUP BY s
    UNION ALL SELECT 'rule_id', rule_id, count(*), false FROM rows_ GROUP BY rule_id""")
def sidebar_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sections(_rows(spark, sf_dir), views.drill("errors"))


@query(f"WITH {ROWS} SELECT {_ALL}, status FROM rows_ WHERE status = 'new'")
def new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.new_only(_rows(spark, sf_dir))


@query(f"WITH {findings_sql()} SELECT {_ALL} FROM found WHERE severity IN ('warning', 'error')")
def min_severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.min_severity(_findings(spark, sf_dir), "warning")


@query(f"WITH {findings_sql()} SELECT count_if(severity = 'info')::BIGINT AS withheld FROM found")
def withheld_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.withheld(_findings(spark, sf_dir), "warning")


@query(f"WITH {ROWS} SELECT s AS fail_on, (SELECT count_if(status = 'new' AND ({_RANK}) >= k) FROM rows_) > 0 AS fails FROM (VALUES ('info', 0), ('warning', 1), ('error', 2)) v(s, k)")
def fail_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = checkpointed(views.new_only(_rows(spark, sf_dir)))
    return spark.createDataFrame([(at, scan.fails(new, at)) for at in ("info", "warning", "error")], "fail_on string, fails boolean")


@query(f"WITH {findings_sql()} SELECT path, line, list_sort(list_distinct(list(rule_id))) AS rules FROM found GROUP BY path, line")
def rules_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rules_per_line(_findings(spark, sf_dir))


@query(f"""WITH {findings_sql()}, a AS (SELECT path, line, list(DISTINCT rule_id) AS x FROM found WHERE severity <> 'info' GROUP BY ALL), b AS (SELECT path, line, list(DISTINCT rule_id) AS y FROM found WHERE rule_id <> 'text.email' GROUP BY ALL)
    SELECT path, line, CASE WHEN y IS NULL THEN 'only-ours' WHEN x IS NULL THEN 'only-theirs' WHEN list_has_any(x, y) THEN 'same' ELSE 'differing' END AS bucket FROM a FULL JOIN b USING (path, line)""")
def scanner_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir)
    return sinks.parity(sinks.rules_per_line(found.where("severity <> 'info'")), sinks.rules_per_line(found.where("rule_id <> 'text.email'")))


@query(f"""WITH {findings_sql()}, cut AS (SELECT path, CASE WHEN ends_with(content, chr(10)) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS ls FROM files),
    w AS (SELECT f.path, f.line, ls, greatest(1, least(f.line - 2, len(ls) - 4))::BIGINT AS first_line FROM found f JOIN cut USING (path)) SELECT path, line, first_line, ls[first_line:first_line + 4] AS shown FROM w""")
def source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.context(_findings(spark, sf_dir), _files(spark, sf_dir))


# --- sinks

@query(f"WITH {findings_sql()} SELECT path, line, \"column\", rule_id, path || ':' || line || ':' || \"column\" || ' ' || severity || ' ' || rule_id || ' ' || message AS text FROM found")
def text_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.listed(_findings(spark, sf_dir))


@query(f"WITH {findings_sql()} SELECT rule_id, CASE severity WHEN 'info' THEN 'note' ELSE severity END AS level, path AS uri, greatest(column_utf16, 1) AS start_column FROM found")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sinks.sarif_results(_findings(spark, sf_dir), rules().redacted())
    where = "$.locations[0].physicalLocation."
    return r.select("rule_id", "level", F.get_json_object("result", where + "artifactLocation.uri").alias("uri"), F.get_json_object("result", where + "region.startColumn").cast("long").alias("start_column"))


@query(f"WITH {findings_sql()} SELECT DISTINCT rule_id, false AS builtin FROM found")
def sarif_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.descriptor_ids(_findings(spark, sf_dir))


@query(lambda: f"""WITH RECURSIVE {findings_sql()}, {_PLAIN}, t AS (SELECT sum(lines)::BIGINT AS n, (SELECT coalesce(sum(duplicated_lines), 0) FROM dup)::BIGINT AS d FROM met)
    SELECT (SELECT count(*) FROM found) AS findings, 0::BIGINT AS baselined, 0::BIGINT AS suppressed, 0::BIGINT AS skipped, '1.2' AS schema_version, (SELECT count(*) FROM files) AS files, n AS lines, d AS duplicated_lines, d / n * 100.0 AS duplication_density,
    (SELECT sha256(string_agg(path || ':' || line || ':' || "column" || ' ' || rule_id || ' ' || fingerprint, chr(10) ORDER BY path, line, "column", rule_id)) FROM found) AS places, (SELECT count(*) FROM found WHERE rule_id = 'text.hex-token') AS withheld, 'scan-root' AS anchor FROM t""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole document as a file, and what it says: its lists by size, its findings in order, its metrics. Its entries are written and read by executors."""
    import hashlib

    from .queries_more import _folder

    path = _folder(spark) / "report.json"
    where = sinks.write_json_report(scan.Scanner(spark, rules()).scan(_files(spark, sf_dir)), path)
    d = sinks.json_outline(path, where)
    t = d["metrics"]["totals"]
    f = F.from_json("value", "path string, line string, column string, rule_id string, fingerprint string, matched string")
    found = sinks.json_entries(spark, path, where["findings"]).select(f.alias("f")).select("f.*")
    place = F.concat("path", F.lit(":"), "line", F.lit(":"), "column", F.lit(" "), "rule_id", F.lit(" "), "fingerprint")
    found = checkpointed(found.select(place.alias("value"), (F.col("matched") == sinks.REDACTED).alias("withheld")))
    n = found.agg(F.count("value").alias("findings"), F.count_if("withheld").alias("withheld")).first()
    places = hashlib.sha256()
    for piece in sinks.ordered_bytes(found.select("value")):
        places.update(piece)
    others = (sinks.json_entries(spark, path, where[k]).count() for k in ("baselined", "suppressed", "skipped"))
    row = (
        n["findings"], *others, d["schema_version"], sinks.json_entries(spark, path, where["files"], 6).count(), t["lines"], t["duplicated_lines"], t["duplication_density"],
        places.hexdigest(), n["withheld"], d["anchor"],
    )
    return spark.createDataFrame([row], "findings long, baselined long, suppressed long, skipped long, schema_version string, files long, lines long, duplicated_lines long, duplication_density double, places string, withheld long, anchor string")


@query(lambda: f"WITH RECURSIVE {_BLOCKS}, t AS (SELECT sum(lines)::BIGINT AS n, (SELECT coalesce(sum(duplicated_lines), 0) FROM dup)::BIGINT AS d FROM met), c AS (SELECT sum(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*#'))))::BIGINT AS code FROM files) SELECT n || ' lines, ' || code || ' code lines, ' || d || ' duplicated (' || printf('%.1f', d / n * 100.0) || '%)' AS text FROM t, c")
def metrics_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as Python files, so that all have code lines."""
    f = _files(spark, sf_dir).withColumn("language", F.lit("python"))
    return sinks.metrics_line(scan.totals(scan.file_metrics(f)))


# --- duplication

_TOKENS = rf"""{FILES}, toks AS (SELECT path, i::BIGINT AS line, trim(ls[i], ' ' || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS tok
        FROM (SELECT path, string_split(content, chr(10)) AS ls FROM files), unnest(range(1, len(ls) + 1)) AS u(i) WHERE regexp_matches(ls[i], '\S')),
    win AS (SELECT path, tok, line, last_value(line) OVER w AS last_line, list(t) OVER w AS ts FROM toks WINDOW w AS (PARTITION BY path ORDER BY tok ROWS BETWEEN CURRENT ROW AND {duplication.MIN_LINES - 1} FOLLOWING)),
    rep AS (SELECT ts, count(*) AS copies FROM win WHERE len(ts) = {duplication.MIN_LINES} GROUP BY ts HAVING count(*) > 1),
    hit AS (SELECT w.path, w.tok, w.line, w.last_line, copies, ts FROM win w JOIN rep USING (ts)),
    cov AS (SELECT path, count(DISTINCT t.line)::BIGINT AS duplicated_lines FROM toks t WHERE EXISTS (SELECT 1 FROM hit h WHERE h.path = t.path AND t.tok BETWEEN h.tok AND h.tok + {duplication.MIN_LINES - 1}) GROUP BY path),
    met AS (SELECT path, count(*)::BIGINT AS lines, coalesce(any_value(duplicated_lines), 0)::BIGINT AS dup FROM toks LEFT JOIN cov USING (path) GROUP BY path)"""


@query(f"WITH {_TOKENS} SELECT path, tok::BIGINT AS tok, line, last_line, copies FROM hit")
def dup_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.repeated(_files(spark, sf_dir)).select("path", "tok", "line", "last_line", "copies")


@query(f"WITH {_TOKENS} SELECT path, duplicated_lines FROM cov")
def dup_covered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.covered_lines(_files(spark, sf_dir))


def _window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_metrics(spark, sf_dir).join(duplication.covered_lines(_files(spark, sf_dir)), "path", "left").select("path", "lines", F.coalesce("duplicated_lines", F.lit(0)).alias("duplicated_lines"))


def _gate_rule(scope: str) -> Rule:
    return Rule(id=f"gates.{scope}", severity="warning", message="Too much is repeated.", kind="duplication", limit=3.0, scope=scope)


def _gate_sql(scope: str, rows: str) -> str:
    text = f"CASE WHEN identity = '' THEN '' ELSE identity || ': ' END || 'density ' || printf('%.1f', 100.0 * dup / lines) || '% (max 3.0%)'"
    return f"WITH {_TOKENS}, g AS ({rows}) SELECT path, {text} AS matched, sha256('gates.{scope}' || chr(0) || path || chr(0) || identity || chr(0) || '0') AS fingerprint FROM g WHERE lines > 0 AND 100.0 * dup / lines > 3.0"


@query(_gate_sql("file", "SELECT path, '' AS identity, lines, dup FROM met"))
def dup_gate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.gate(_gate_rule("file"), _window_metrics(spark, sf_dir)).select("path", "matched", "fingerprint")


@query(_gate_sql("silo", f"SELECT '.' AS path, 'silo ' || {_DIR} AS identity, sum(lines) AS lines, sum(dup) AS dup FROM met GROUP BY 2"))
def dup_gate_silo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.gate(_gate_rule("silo"), _window_metrics(spark, sf_dir), _silos(spark, sf_dir)).select("path", "matched", "fingerprint")


@query(_gate_sql("scan", "SELECT '.' AS path, '' AS identity, sum(lines) AS lines, sum(dup) AS dup FROM met"))
def dup_gate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.gate(_gate_rule("scan"), _window_metrics(spark, sf_dir)).select("path", "matched", "fingerprint")


# The greedy pass as a recursion over the starts of repeated windows in order: a state holds the tokens used so far and the
# blocks found. Tokens are numbered over all files; a file's first token is two behind the last of the one before.
_BLOCKS = rf"""{_TOKENS}, num AS (SELECT path, line, t, dense_rank() OVER (ORDER BY t) AS x, row_number() OVER (ORDER BY path, tok) + 2 * (dense_rank() OVER (ORDER BY path)) AS g, count(*) OVER (PARTITION BY path) - tok AS run, tok FROM toks),
    big AS (SELECT map_from_entries(list((g, x))) AS xs, map_from_entries(list((g, run))) AS runs FROM num WHERE path IN (SELECT path FROM hit)),
    st AS (SELECT row_number() OVER (ORDER BY g) AS i, g AS s, list_sort(list(g) OVER (PARTITION BY ts)) AS os FROM hit JOIN num USING (path, tok)),
    rec AS (SELECT 1::BIGINT AS i, []::BIGINT[] AS used, 0::BIGINT AS s, 0::BIGINT AS size, []::BIGINT[] AS chosen UNION ALL
        SELECT i + 1, CASE WHEN size > 0 THEN list_concat(used, flatten(list_transform(chosen, lambda o: range(o, o + size)))) ELSE used END, s, size, CASE WHEN size > 0 THEN chosen ELSE []::BIGINT[] END FROM (
            SELECT i, used, s, chosen, CASE WHEN len(chosen) > 1 THEN size ELSE 0 END AS size FROM (
                SELECT i, used, s, size, CASE WHEN len(grp) < 2 THEN []::BIGINT[] ELSE list_reduce(list_transform(grp, lambda o: [o]), lambda a, b: CASE WHEN b[1] >= a[-1] + size THEN list_concat(a, b) ELSE a END) END AS chosen FROM (
                    SELECT i, used, s, grp, list_filter(range({duplication.MIN_LINES}, runs[s] + 1), lambda e: e >= runs[s] OR list_contains(used, s + e) OR len(list_filter(grp, lambda o: e >= runs[o] OR list_contains(used, o + e) OR xs[o + e] <> xs[s + e])) > 0)[1]::BIGINT AS size, xs, runs FROM (
                        SELECT rec.i, used, st.s, CASE WHEN list_contains(used, st.s) THEN []::BIGINT[] ELSE list_filter(os, lambda o: o >= st.s AND NOT list_has_any(used, range(o, o + {duplication.MIN_LINES}))) END AS grp, xs, runs
                        FROM rec JOIN st ON st.i = rec.i, big))))),
    blk AS (SELECT s, size, unnest(chosen) AS o FROM rec WHERE size > 0),
    txt AS (SELECT s, size, sha256(string_agg(t, chr(10) ORDER BY g))[1:12] AS block FROM (SELECT DISTINCT s, size FROM blk) JOIN num ON g >= s AND g < s + size GROUP BY s, size),
    blocks AS (SELECT block, size AS line_count, a.path, a.line AS start_line, b.line AS end_line, s FROM blk JOIN txt USING (s, size) JOIN num a ON a.g = o JOIN num b ON b.g = o + size - 1),
    dup AS (SELECT t.path, count(DISTINCT t.line)::BIGINT AS duplicated_lines FROM toks t JOIN blocks b ON b.path = t.path AND t.line BETWEEN b.start_line AND b.end_line GROUP BY t.path),
    spots AS (SELECT *, path || ':' || start_line AS place, row_number() OVER w AS k, count(*) OVER (PARTITION BY s) AS n, list(path || ':' || start_line) OVER (PARTITION BY s ORDER BY path, start_line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ps FROM blocks WINDOW w AS (PARTITION BY s ORDER BY path, start_line)),
    told AS (SELECT *, list_filter(ps, lambda p: p <> place)[1:10] AS others, line_count || ' duplicated lines (block ' || block || ')' AS matched FROM spots),
    dupf AS (SELECT 'metrics.duplicate-block' AS rule_id, 'info' AS severity, 'duplicated block, also at ' || array_to_string(others, ', ') || CASE WHEN n - 1 > len(others) THEN ', and ' || (n - 1 - len(others)) || ' more' ELSE '' END AS message,
        path, start_line AS line, 1::BIGINT AS "column", 1::BIGINT AS column_utf16, matched, sha256('metrics.duplicate-block' || chr(0) || path || chr(0) || matched || chr(0) || (row_number() OVER (PARTITION BY path, matched ORDER BY block, start_line) - 1)) AS fingerprint, block, line_count FROM told)"""


@query(f"WITH RECURSIVE {_BLOCKS} SELECT block, line_count, path, start_line, end_line FROM blocks")
def dup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.copies(_files(spark, sf_dir)).drop("first")


@query(f"WITH RECURSIVE {_BLOCKS} SELECT path, duplicated_lines FROM dup")
def dup_lines_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.duplicated_lines(_files(spark, sf_dir))


@query(f"WITH RECURSIVE {_BLOCKS} SELECT {_ALL} FROM dupf")
def dup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplication.block_findings(duplication.copies(_files(spark, sf_dir)))


@query(f"WITH RECURSIVE {_BLOCKS} SELECT block, count(*) AS copies, max(line_count)::BIGINT AS lines FROM dupf GROUP BY block")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.duplicate_groups(duplication.block_findings(duplication.copies(_files(spark, sf_dir))))


@query(f"WITH RECURSIVE {_BLOCKS} SELECT f.path, coalesce(lines, 0)::BIGINT AS lines, NULL::BIGINT AS code_lines, coalesce(duplicated_lines, 0)::BIGINT AS duplicated_lines FROM files f LEFT JOIN met USING (path) LEFT JOIN dup USING (path)")
def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.file_metrics(_files(spark, sf_dir))


# the same over files without markers, beside other files
_PLAIN = _BLOCKS.replace("files AS (", "plain AS (").replace("FROM files", "FROM plain")


# --- coverage

_ROLLED = """roll AS (SELECT path, count(*)::BIGINT AS lines_total, count_if(hits > 0)::BIGINT AS lines_covered FROM (
        SELECT 'lib/' || (l_suppkey // 10) || '/' || l_suppkey || '.py' AS path, l_partkey AS line, max(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END) AS hits FROM lineitem GROUP BY ALL) GROUP BY path)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage report made of order lines: supplier as file, part as line, what was returned as hits."""
    s = F.col("l_suppkey")
    path = F.concat(F.lit("lib/"), F.floor(s / 10).cast("string"), F.lit("/"), s.cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "lineitem").select(path.alias("path"), F.col("l_partkey").alias("line"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(0).alias("hits"))


@query(f"WITH {_ROLLED} SELECT path, lines_total, lines_covered FROM roll")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.rolled_up(_hits(spark, sf_dir))


@query(f"WITH {_ROLLED} SELECT path, lines_total, lines_covered FROM roll")
def coverage_lcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report, written as LCOV lines and read again."""
    rows = by_size(_hits(spark, sf_dir), "path").groupBy("path").agg(F.collect_list(F.concat(F.lit("DA:"), F.col("line").cast("string"), F.lit(","), F.col("hits").cast("string"))).alias("da"))
    text = F.concat(F.array(F.lit("TN:"), F.concat(F.lit("SF:"), F.translate("path", "/", "\\"))), F.col("da"), F.array(F.lit("end_of_record"), F.lit("DA:1,1")))
    return reports.lcov(rows.select(text.alias("lines")))


_SCANNED = """scanned AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'lib/' ELSE 'app/lib/' END || (s_suppkey // 10) || '/' || s_suppkey || '.py' AS path FROM supplier),
    exact AS (SELECT r.* FROM roll r JOIN scanned USING (path)), pend AS (SELECT * FROM roll WHERE path NOT IN (SELECT path FROM scanned)), free AS (SELECT path FROM scanned WHERE path NOT IN (SELECT path FROM roll)),
    pairs AS (SELECT p.path AS reported, f.path AS path FROM pend p, free f WHERE ends_with(f.path, '/' || p.path) OR ends_with(p.path, '/' || f.path)),
    one AS (SELECT *, count(*) OVER (PARTITION BY reported) AS n FROM pairs), two AS (SELECT *, count(*) OVER (PARTITION BY path) AS k FROM one WHERE n = 1),
    res AS (SELECT * FROM exact UNION ALL SELECT t.path, p.lines_total, p.lines_covered FROM two t JOIN pend p ON p.path = t.reported WHERE k = 1)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    scanned = table(spark, sf_dir, "supplier").select(F.concat(F.when(s % 3 == 0, "lib/").otherwise("app/lib/"), F.floor(s / 10).cast("string"), F.lit("/"), s.cast("string"), F.lit(".py")).alias("path"))
    return coverage.resolve(coverage.rolled_up(_hits(spark, sf_dir)), scanned)


@query(f"WITH {_ROLLED}, {_SCANNED} SELECT path, lines_total, lines_covered FROM res")
def coverage_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(f"""WITH {_ROLLED}, {_SCANNED} SELECT path, lines_covered || '/' || lines_total || ' lines (' || printf('%.1f', 100.0 * lines_covered / lines_total) || '%)' AS matched,
    sha256('gates.coverage' || chr(0) || path || chr(0) || chr(0) || '0') AS fingerprint FROM res WHERE 100.0 * lines_covered / lines_total < 35""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule(id="gates.coverage", severity="warning", message="Too little is covered.", kind="coverage", limit=35.0)
    return coverage.gate(rule, _resolved(spark, sf_dir)).select("path", "matched", "fingerprint")


# --- boundaries: pages as modules that import the one seven on, silos by host

_IMPORTS = """mods AS (SELECT 'web/' || regexp_extract(url, '^https?://([^/]+)', 1) || '/p' || page_id || CASE WHEN page_id % 2 = 0 THEN '.js' ELSE '/index.ts' END AS path, page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
    imp AS (SELECT a.path, a.host, '../' || CASE WHEN a.page_id % 2 = 0 THEN '' ELSE '../' END || b.host || '/p' || b.page_id AS raw, b.path AS target, b.host AS to_host FROM mods a JOIN mods b ON b.page_id = a.page_id + 7)"""


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    end = F.when(F.col("page_id") % 2 == 0, ".js").otherwise("/index.ts")
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.concat(F.lit("web/"), host, F.lit("/p"), F.col("page_id").cast("string"), end).alias("path"))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _modules(spark, sf_dir)
    b = m.select((F.col("page_id") - 7).alias("page_id"), F.col("host").alias("h"), F.col("page_id").alias("p"))
    raw = F.concat(F.lit("../"), F.when(F.col("page_id") % 2 == 0, "").otherwise("../"), F.col("h"), F.lit("/p"), F.col("p").cast("string"))
    one = F.lit(1).cast("long")
    return m.join(b, "page_id").select("path", F.lit("javascript").alias("language"), F.lit(0).cast("long").alias("position"), raw.alias("raw"), one.alias("line"), one.alias("column"), one.alias("column_utf16"))


def _host_silos(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    return {"mobile": ["web/m.*/*"], "blog": ["web/blog.*/*"], "main": ["web/www.*/*", "web/**"]}


@query(f"WITH {_IMPORTS} SELECT path, raw, target FROM imp")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.resolve(_imports(spark, sf_dir), _modules(spark, sf_dir)).select("path", "raw", "target")


@query("WITH " + _IMPORTS + " SELECT DISTINCT path, CASE WHEN starts_with(host, 'blog.') THEN 'blog' ELSE 'main' END AS silo FROM mods")
def path_silos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.silo_of(_modules(spark, sf_dir), _host_silos(spark, sf_dir))


_VIOLATIONS = _IMPORTS + """, v AS (SELECT path, raw, CASE WHEN starts_with(host, 'blog.') THEN 'blog' ELSE 'main' END AS from_silo, CASE WHEN starts_with(to_host, 'blog.') THEN 'blog' ELSE 'main' END AS to_silo FROM imp),
    d AS (SELECT *, CASE from_silo WHEN 'blog' THEN 'edges.blog' ELSE 'edges.main' END AS rule_id FROM v WHERE from_silo <> to_silo),
    x AS (SELECT rule_id, path, raw AS matched, sha256(rule_id || chr(0) || path || chr(0) || raw || chr(0) || '0') AS fingerprint, from_silo, to_silo FROM d)"""


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = [Rule(id=f"edges.{a}", severity="error", message="Not allowed.", kind="boundary", source=a, deny=(b,)) for a, b in (("blog", "main"), ("main", "blog"))]
    modules = _modules(spark, sf_dir)
    return boundary.violations(boundary.resolve(_imports(spark, sf_dir), modules), boundary.silo_of(modules, _host_silos(spark, sf_dir)), pair)


@query(f"WITH {_VIOLATIONS} SELECT rule_id, path, matched, fingerprint, from_silo, to_silo FROM x")
def boundary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir).select("rule_id", "path", "matched", "fingerprint", "from_silo", "to_silo")


@query(f"""WITH {_VIOLATIONS}, w AS (SELECT from_silo AS s FROM x UNION SELECT to_silo FROM x) SELECT a.s AS from_silo, b.s AS to_silo, count(DISTINCT x.fingerprint) AS violations
    FROM w a CROSS JOIN w b LEFT JOIN x ON x.from_silo = a.s AND x.to_silo = b.s GROUP BY 1, 2""")
def silo_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.matrix(_violations(spark, sf_dir).select("from_silo", "to_silo", "fingerprint"))


@query(f"WITH {_VIOLATIONS} SELECT rule_id, path, matched FROM x WHERE from_silo = 'blog' AND to_silo = 'main'")
def edge_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _violations(spark, sf_dir)
    return views.cell(v, v, "blog", "main").select("rule_id", "path", "matched")


@query("""SELECT page_id, count(*)::BIGINT AS imports FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) WHERE h <> '' GROUP BY page_id""")
def fact_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of a page turned into an include line of a C file, and found again by the fact extractor."""
    links = F.array_join(F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: F.concat(F.lit('#include "'), h, F.lit('"'))), "\n")
    f = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".c")).alias("path"), links.alias("content"))
    return facts.import_table(f).groupBy("path").agg(F.count(F.lit(1)).alias("imports")).select(F.substring_index("path", ".", 1).cast("long").alias("page_id"), "imports")


@query("SELECT c_custkey AS line_key, 'load_' || c_custkey AS name, 'function' AS kind FROM customer UNION ALL SELECT c_custkey, 'Customer' || c_custkey, 'class' FROM customer")
def fact_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    body = F.concat(F.lit("class Customer"), k, F.lit(":\n    def load_"), k, F.lit("(self):\n        return None\n"))
    f = table(spark, sf_dir, "customer").select(F.concat(k, F.lit(".py")).alias("path"), body.alias("content"))
    return facts.declaration_table(f).select(F.substring_index("path", ".", 1).cast("long").alias("line_key"), "name", "kind")


@query("SELECT o_orderkey || '.py' AS path, 2::BIGINT AS line, 'eval(' || o_custkey || ')' AS matched FROM orders WHERE o_orderstatus = 'O'")
def ast_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.concat(F.lit("def f():\n    "), F.when(F.col("o_orderstatus") == "O", "eval(").otherwise("save("), F.col("o_custkey").cast("string"), F.lit(")\n"))
    f = table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"), call.alias("content"))
    rule = Rule(id="code.eval", severity="error", message="eval", kind="ast", languages=("python",), queries=(("python", '(call function: (identifier) @_f (#eq? @_f "eval")) @report'),))
    return syntax.findings(f, [rule]).select("path", "line", "matched")


# --- scalars

@query("SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda s: url_encode(s)), '/') AS uri FROM pages")
def uri_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.uri_reference("url").alias("uri"))


@query(r"SELECT doc_id, replace(replace(text, chr(10), '\x0a'), chr(9), '\x09') AS clean FROM documents")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.sanitize("text").alias("clean"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalize_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_space("text").alias("text"))


@query("SELECT l_orderkey, l_linenumber, printf('%.1f', l_extendedprice / 8) AS shown FROM lineitem")
def one_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.one_decimal(F.col("l_extendedprice") / 8).alias("shown"))


@query("SELECT doc_id, sha256(text) AS content_hash, sha256('rules' || chr(0) || source || chr(0) || text) AS scope_hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash("text").alias("content_hash"), X.scope_hash(F.lit("rules"), "source", "text").alias("scope_hash"))


@query("""SELECT page_id, CASE WHEN k = 0 THEN NULL ELSE 'a/c/' || page_id || '.js' END AS joined FROM (SELECT page_id, page_id % 4 AS k FROM pages)""")
def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id").cast("string")
    base = F.when(F.col("page_id") % 4 == 0, "").otherwise("a/b")
    return table(spark, sf_dir, "pages").select("page_id", paths.joined(base, F.concat(F.lit("../c/./d/../"), p, F.lit(".js"))).alias("joined"))


@query("""SELECT page_id, contains(url, 'blog.') AS a, regexp_matches(url, '^https?://m\\.[^?]*/en/\\d') AS b FROM pages""")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.matches_any("url", ["*blog.*"]).alias("a"), paths.matches_any(F.regexp_replace("url", r"\?.*", ""), ["http{,s}://m.*/en/[0-9]*"]).alias("b"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'error' WHEN '2-HIGH' THEN 'warning' ELSE 'note' END AS level, CASE WHEN o_custkey = 1 THEN '1 file' ELSE o_custkey || ' files' END AS said FROM orders")
def severity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.sarif_level(F.when(p == "1-URGENT", "error").when(p == "2-HIGH", "warning").otherwise("info")).alias("level"), X.quantity("o_custkey", "file").alias("said"))


@query(r"""SELECT doc_id, CASE WHEN contains(text, 'Licensed') THEN 'binary' ELSE 'text' END AS kind FROM documents""")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.contains("text", F.lit("Licensed")), F.concat(F.lit("PK"), F.lit("\x00"))).otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.col("text")).cast("binary").alias("bytes"))
    return sources.classified(d).select("doc_id", "kind")


@query(f"WITH {FILES} SELECT path, regexp_replace(content, '^([^\\n]*)', '\\1 # auditlake-ignore-line: a.b') AS content FROM files")
def insert_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return f.select("path", markers.insert_marker("content", "path", F.lit(1), F.lit("a.b")).alias("content"))


@query(f"WITH {findings_sql()} SELECT {_ALL} FROM found")
def incremental_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents first; then all, of which only the others are scanned, and the English ones' findings come from the cache."""
    files = _files(spark, sf_dir)
    _, rows = incremental.scan_batch(files.where(F.contains("path", F.lit("/en/"))), rules(), salt="s")
    return incremental.scan_batch(files, rules(), checkpointed(rows), "s")[0]


@query("SELECT date_trunc('minute', ts) AS minute, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS severity, count(*) AS findings FROM events GROUP BY ALL")
def counts_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"))
    return incremental.counts_by_minute(e)


ORACLE_SQL.update((name, sql()) for name, sql in _LATER)

from . import queries_more as _more  # noqa: E402, F401  (registers its queries here)
