import json
import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from auditlake.config import Config
from auditlake.operators import baseline, matching
from auditlake.plans import progress, ratchet, scan, views
from auditlake.rulesets.loader import load_text
from auditlake.sinks import reports as sinks
from auditlake.sources import files as S
from auditlake.sources import reports as R
from auditlake.streaming import incremental

RULES = load_text("""version: 1
rules:
  - {id: t.word, severity: warning, message: A word., regex: {pattern: needle}}
  - {id: t.secret, severity: error, message: A secret., secret: {pattern: 'key=(\\w+)', group: 1, keywords: [key]}}
  - {id: t.gate, severity: info, message: Repeated., duplication: {max_percent: 10, scope: file}}
""")


@pytest.fixture
def report(spark, files):
    block = "\n".join(f"same {k}" for k in range(4))
    f = files({"a.py": f"needle\n# auditlake-ignore: t.word\nneedle\n{block}", "b/c.rs": f"key=abc\n{block}\n", "d.bin": "x"})
    accepted = baseline.entries(scan.Scanner(spark, RULES).scan(files({"a.py": "needle"})).findings)
    return scan.Scanner(spark, RULES, Config(min_lines=4, report_blocks=True)).scan(f, accepted)


def test_report(report, tmp_path, spark):
    assert [(r["rule_id"], r["path"], r["line"]) for r in report.findings.collect()] == [("t.gate", "a.py", 1), ("metrics.duplicate-block", "a.py", 4), ("t.gate", "b/c.rs", 1), ("t.secret", "b/c.rs", 1), ("metrics.duplicate-block", "b/c.rs", 2)]
    assert [r["line"] for r in report.baselined.collect()] == [1] and [r["line"] for r in report.suppressed.collect()] == [3]
    assert tuple(report.totals.first())[:3] == (13, 11, 8)
    data = json.loads(sinks.json_report(report))
    assert list(data)[:6] == ["version", "findings", "baselined", "suppressed", "skipped", "schema_version"] and data["metrics"]["files"]["d.bin"] == {"lines": 1, "duplicated_lines": 0}
    assert "abc" not in json.dumps([f["matched"] for f in data["findings"]]) and all("column_utf16" not in f for f in data["findings"])
    p = tmp_path / "r.json"
    p.write_text(json.dumps(data))
    back, rest = R.read_report(spark, str(p))
    assert back.groupBy("status").count().count() == 3 and rest["schema_version"] == "1.2"
    low = json.loads(sinks.json_report(report, least="error"))
    assert low["min_severity"] == "error" and [f["rule_id"] for f in low["findings"]] == ["t.secret"]


def test_old_reports_withhold_matches(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"schema_version": "1.0", "findings": [dict(rule_id=r, matched=m, new=1) for r, m in (("a.b", "x"), ("metrics.duplicate-block", "y"))]}))
    assert {r["matched"] for r in R.read_report(spark, str(p))[0].collect()} == {"<redacted>", "y"}
    for text, said in (("{", "not JSON"), ("{}", "no scan report"), ('{"findings": [], "schema_version": "2.0"}', "version")):
        p.write_text(text)
        with pytest.raises(R.ReportError, match=said):
            R.read_report(spark, str(p))


def test_sarif(report):
    run = json.loads(sinks.sarif_report(report, RULES))["runs"][0]
    assert [d["id"] for d in run["tool"]["driver"]["rules"]] == ["metrics.duplicate-block", "t.gate", "t.secret"] and len(run["results"]) == 5
    place = run["results"][-1]["locations"][0]["physicalLocation"]
    assert place["artifactLocation"]["uri"] == "b/c.rs" and place["region"]["startLine"] == 2


def test_text_and_exit(report, tmp_path, spark):
    text = sinks.text_report(report, least="warning")
    assert "b/c.rs:1:5 error t.secret A secret.\n" in text and "5 new, 1 baselined, 1 suppressed" in text and "4 below warning not shown" in text and "13 lines, 11 code lines, 8 duplicated (61.5%)" in text
    assert sinks.exit_status(report) == 1 and scan.fails(report.findings.where("severity = 'info'"), "warning") is False
    sinks.write_baseline(report.findings, tmp_path / "b.json")
    assert R.read_baseline(spark, str(tmp_path / "b.json")).count() == 5 and R.read_baseline(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(R.ReportError):
        R.read_baseline(spark, str(tmp_path / "none.json"), explicit=True)
    (tmp_path / "b.json").write_text('{"version": 3, "entries": []}')
    with pytest.raises(R.ReportError, match="version"):
        R.read_baseline(spark, str(tmp_path / "b.json"))


def test_partitions_change_nothing(spark, files):
    f = files({f"p{k}": "needle key=x9\n" * (k % 5) for k in range(30)})
    one = scan.Scanner(spark, RULES).scan(f.repartition(1)).findings.collect()
    assert one == scan.Scanner(spark, RULES).scan(f.repartition(7)).findings.collect()


def test_setup_errors(spark, files):
    f = files({"a": "x"})
    for body, said in (("coverage: {min: 1}", "report"), ("boundary: {from: a, deny: [b]}", "silos"), ("duplication: {max_percent: 1, scope: silo}", "silo")):
        rules = load_text(f"version: 1\nrules:\n  - {{id: a.b, severity: info, message: m, {body}}}\n")
        with pytest.raises(scan.SetupError, match=said):
            scan.Scanner(spark, rules).scan(f)
    rules = load_text("version: 1\nrules:\n  - {id: a.b, severity: info, message: m, coverage: {min: 1}}\n")
    other = spark.createDataFrame([("zzz", 1, 0)], "path string, lines_total long, lines_covered long")
    with pytest.raises(scan.SetupError, match="none"):
        scan.Scanner(spark, rules).scan(f, report=other)
    assert scan.Scanner(spark, rules).scan(f, report=other, partial=True).warnings


def test_views(report, spark):
    rows = report.rows().cache()
    assert {r[0]: r[1] for r in views.severity_counts(rows).collect()} == {"info": 4, "warning": 2, "error": 1}
    assert tuple(views.debt(rows).first()) == (5, 1, 1) and views.gate(rows).first()[0] == "FAILED" and views.rating(rows).first()[0] == "C"
    assert [r["copies"] for r in views.duplicate_groups(rows).collect()] == [2]
    assert views.filtered(rows, **views.drill("debt")).count() == 2 and views.filtered(rows, text="SECRET").count() == 1
    assert views.kpis(rows, report.totals).first()["debt"] == 2
    with pytest.raises(ValueError):
        views.drill("x")
    e = spark.createDataFrame([("a", "b", "f1"), ("a", "b", "f1"), ("b", "c", "f2")], "from_silo string, to_silo string, fingerprint string")
    assert views.matrix(e).count() == 9 and views.pivoted(e).count() == 2
    with pytest.raises(ValueError):
        views.silo_drill(rows, spark.createDataFrame([], "path string, silo string"), "x")
    assert views.silo_drill(rows, spark.createDataFrame([("a.py", "x")], "path string, silo string"), "x").count() == rows.where("path = 'a.py'").count() > 0
    assert [r[0] for r in spark.range(4).select(views.bar_cells(F.col("id"), F.lit(3), 10)).collect()] == [0, 3, 7, 10]


def test_lcov_and_cobertura(spark, tmp_path):
    p = tmp_path / "x.info"
    p.write_text("TN:\nSF:a\\b.c\nDA:1,0\nDA:2,5\nend_of_record\nDA:9,9\nSF:a/b.c\nDA:1,3\nend_of_record\nSF:s.c\nLF:4\nLH:9\nend_of_record\nSF:e.c\nend_of_record\n")
    assert sorted(map(tuple, R.read_coverage(spark, str(p)).collect())) == [("a/b.c", 2, 2), ("e.c", 0, 0), ("s.c", 4, 4)]
    x = tmp_path / "x.xml"
    line = lambda n, h: f'<line hits="{h}" number="{n}"/>'
    first = f"<methods><method><lines>{line(7, 1)}</lines></method></methods><lines>{line(1, 0)}{line(2, 2)}</lines>"
    classes = "".join(f'<class name="k" filename="a.py">{body}</class>' for body in (first, f"<lines>{line(1, 1)}</lines>"))
    x.write_text(f"<coverage>\n<packages>\n<package><classes>\n{classes}\n</classes>\n</package>\n</packages> {chr(10)}</coverage>")
    assert sorted(map(tuple, R.read_coverage(spark, str(x)).collect())) == [("a.py", 2, 2)]
    for text in ("<other/>", "nothing"):
        with pytest.raises(R.ReportError):
            R.coverage_format(text)


def test_walk(spark, tmp_path):
    for name, text in {".gitignore": "*.log\nbuild/\n!keep.log\n/top\n", "a.py": "x", "x.log": "", "keep.log": "", "build/y": "", "sub/top": "", "top": "", "sub/.ignore": "z*\n", "sub/z1": "", ".env": "K=1", ".git/c": "", "n.bin": "a\0b"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    (tmp_path / "bad").write_bytes(b"\xff\xfe")
    os.symlink(tmp_path / "a.py", tmp_path / "in")
    os.symlink("/etc/hostname", tmp_path / "out")
    os.symlink(tmp_path / "gone", tmp_path / "broken")
    os.symlink(tmp_path, tmp_path / "sub" / "up")
    w = S.walk(tmp_path)
    assert w.files == [".env", ".gitignore", "a.py", "bad", "in", "keep.log", "n.bin", "sub/.ignore", "sub/top"]
    assert (w.ignored_files, w.ignored_directories) == (3, 1) and S.ignored_summary(3, 1) == "ignored 3 files and 1 directory" and S.ignored_summary(0, 0) is None
    assert dict(w.symlinks) == {"in": "inside-root", "out": "outside-root", "broken": "broken", "sub/up": "cycle"}
    assert "x.log" in S.walk(tmp_path, S.Policy.everything()).files and S.walk(tmp_path / "a.py").files == ["a.py"]
    got = {r["path"]: (r["kind"], r["reason"]) for r in S.read_tree(spark, tmp_path, w, "pre").collect()}
    assert got["pre/n.bin"] == ("binary", None) and got["pre/bad"] == ("unreadable", S.INVALID) and got["pre/a.py"] == ("text", None) and len(got) == 9
    (tmp_path / "sub" / "keep.log").write_text("")
    assert "keep.log" in S.walk(tmp_path / "sub").files and "up" not in S.walk(tmp_path / "sub").files
    (tmp_path / "all").write_text("a.*\n")
    (tmp_path / ".git" / "info").mkdir()
    (tmp_path / ".git" / "info" / "exclude").write_text("n.bin\n")
    for policy, gone in ((S.Policy(global_ignore=tmp_path / "all"), "a.py"), (S.Policy(git_exclude=True), "n.bin")):
        assert gone in S.walk(tmp_path).files and gone not in S.walk(tmp_path, policy).files
    assert "sub/top" in S.walk(tmp_path, S.Policy(parents=True)).files
    (tmp_path / "sub" / "y.log").write_text("")
    assert "y.log" in S.walk(tmp_path / "sub").files and "y.log" not in S.walk(tmp_path / "sub", S.Policy(parents=True)).files
    outer = S.project_ignores(tmp_path, tmp_path / "sub")
    (tmp_path / "sub" / "q.log").write_text("")
    assert "q.log" not in S.walk(tmp_path / "sub", outer=outer).files


AST = "version: 1\nrules:\n  - {id: code.eval, severity: error, message: m, ast: {python: '(call function: (identifier) @_f (#eq? @_f \"eval\")) @report'}}\n"


def test_incremental(spark, files, tmp_path):
    rules = RULES.merged(load_text(AST, "ast"))
    f = files({"a": "needle", "b": "none", "c.py": "é = 1\nxé = eval(\n  'ö')\n"})
    found, cache = incremental.scan_batch(f, rules, salt="s")
    cache = cache.cache()
    assert {r["path"]: (r["matched"], r["line"]) for r in found.collect()} == {"a": ("needle", 1), "c.py": ("eval(\n  'ö')", 2)} and cache.count() == 3
    two = f.unionByName(spark.createDataFrame([("b", "a needle!"), ("b", "none"), ("a", "needle"), (None, "needle"), ("n", None)], "path string, content string"))
    again, fresh = incremental.scan_batch(two, rules, cache, "s")
    assert sorted((r["path"], r["line"], r["column"]) for r in again.collect()) == [("a", 1, 1), ("a", 1, 1), ("b", 1, 3), ("c.py", 2, 7)] and fresh.count() == 1
    assert incremental.scan_batch(f, rules, cache, "other")[1].count() == 3  # tags of another salt
    assert incremental.scan_batch(f, rules, cache.withColumn("entries", F.slice("entries", 1, 0)), "s")[1].count() == 2  # all but the entry that was empty before
    assert incremental.scan_batch(f, rules, cache, "s", "config")[1].count() == 3 and incremental.scan_batch(f, RULES, cache, "s")[1].count() == 3
    store = incremental.Cache(spark, str(tmp_path / "cache"), "s")
    for k in range(2):
        assert incremental.scan(f, rules, store, f"{k}").count() == 2
    assert [store.read().count(), len(store.days())] == [3, 1] and store.prune(3) == 0
    assert store.prune(3, date.today() + timedelta(days=9)) == 1 and not store.days()


def test_watch(spark, tmp_path):
    store = incremental.Cache(spark, str(tmp_path / "cache"))
    for k, name in enumerate(("x", "y")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "f.txt").write_text("a needle\n# auditlake-ignore-line: t.word, needle\n" if k else "a needle")
        incremental.watch(spark, str(tmp_path / "in"), RULES, str(tmp_path / "out"), str(tmp_path / "cp"), cache=store).awaitTermination()
    got = sorted((r["batch"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "new"), (1, "new"), (1, "suppressed")] and store.read().count() == 2


def test_ratchet(spark, files, report):
    rows = report.rows()
    new = [r["fingerprint"] for r in report.findings.where("rule_id = 't.secret'").collect()]
    v = ratchet.checked(spark.createDataFrame([(new[0], "ignore"), (new[0], "ignore"), ("zz", "baseline")], "fingerprint string, verdict string"))
    f = files({"b/c.rs": "key=abc\nx", "other": "key=abc"})
    assert [tuple(r) for r in ratchet.silence(f, rows, v).collect()] == [("b/c.rs", "key=abc // auditlake-ignore-line: t.secret\nx")]
    assert ratchet.remaining(rows, v).count() == report.findings.count() - 1 and ratchet.accept(baseline.entries(rows.limit(0)), rows, v).count() == 0
    for bad in ([("a", "shrug")], [("a", "next"), ("a", "ignore")]):
        with pytest.raises(ratchet.RefusedError):
            ratchet.checked(spark.createDataFrame(bad, "fingerprint string, verdict string"))
    with pytest.raises(ratchet.RefusedError):
        ratchet.silence(f, rows, v, live=False)


def test_progress(spark, files):
    said = []
    f = files({f"{k}.txt": "needle" for k in range(9)})
    report = progress.scan_with_progress(scan.Scanner(spark, RULES), f, said.append, every=0.01)
    assert said[0] == progress.Progress(9, 0, 0) and said[-1] == progress.Progress(9, 9, report.findings.count()) and report.findings.count() == 9
    done = [p.files_done for p in said]
    assert done == sorted(done) and [said[0].ratio, said[-1].ratio, progress.Progress(0, 3, 0).ratio, progress.Progress(2, 3, 0).ratio] == [0, 1, 0, 1]


def test_reports_written_by_executors(spark, report, tmp_path):
    sinks.write_json_lines(report, str(tmp_path / "r"))
    sinks.write_sarif_lines(report, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "r" / "findings")).count() == report.rows().count()
    assert all(json.loads(r["value"])["ruleId"] for r in spark.read.text(str(tmp_path / "s")).collect())


def test_rules_without_a_parser_are_named(spark, files):
    rules = load_text("version: 1\nrules:\n  - {id: code.rb, severity: error, message: m, ast: {ruby: '(call) @report'}}\n", "rb")
    assert scan.Scanner(spark, rules).scan(files({"a.rb": "f()"})).warnings == ["rule code.rb: no parser for ruby, so its queries for these find nothing"]


def test_repeated_paths_have_positions_of_their_own(spark):
    f = spark.createDataFrame([("p", "needle\n x needle"), ("p", "\n\n  needle needle"), ("p", "needle\n x needle")], "path string, content string")
    rules = RULES.of("regex")
    native, python = (sorted(map(tuple, d.collect())) for d in (matching.native_findings(f, rules), matching.python_findings(f, rules)))
    assert native == python and len(native) == 6


def test_manifest(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a\t1\tNONE\twhy\nb\t2\tx.y|z.w\twhy\n")
    assert [(r["path"], r["expect"]) for r in R.read_manifest(spark, str(tmp_path / "m.tsv")).collect()] == [("a", []), ("b", ["x.y", "z.w"])]


@pytest.mark.parametrize("parts", [False, True])
def test_streamed_documents_as_file_and_as_folder(spark, tmp_path, monkeypatch, parts):
    """The table may be one file or a folder of parts, and the shared folder may be named by a URL; tables beside it aren't read."""
    from auditlake import queries, queries_more

    docs = spark.createDataFrame([(k, f"Licensed under the X{k} license.", "en", "src1", 30) for k in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(str(tmp_path / ("sf/documents.parquet" if parts else "one")))
    if not parts:
        (tmp_path / "sf").mkdir()
        docs.toPandas().to_parquet(tmp_path / "sf/documents.parquet")
    docs.write.parquet(str(tmp_path / "sf/labels.parquet"))
    monkeypatch.setattr(queries_more, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    got = queries.QUERIES["streamed_findings"](spark, str(tmp_path / "sf")).collect()
    assert sorted((r["path"], r["status"]) for r in got) == [(f"src1/en/0000000{k}.txt", "suppressed") for k in range(4)]


def test_files_are_scanned_once_for_findings_and_cache(spark, files, tmp_path, monkeypatch):
    log, real = tmp_path / "log", matching.findings

    def logged(some, rules, carry=()):
        def run(batches):
            for b in batches:
                with log.open("a") as f:
                    f.write(f"{b.num_rows} ")
                yield b

        d = real(some, rules, carry)
        return d.mapInArrow(run, d.schema)

    monkeypatch.setattr(matching, "findings", logged)
    f, store = files({"a": "needle\nneedle", "b": "é needle"}), incremental.Cache(spark, str(tmp_path / "cache"), "s")
    assert incremental.scan(f, RULES, store, "0").count() == 3 and sum(map(int, log.read_text().split())) == 3
    assert incremental.scan(f, RULES, store, "0").count() == 3 and store.read().count() == 2  # a batch that is run again replaces its part


def test_matches_are_read_from_files_again(spark):
    places = [(1, 9, 6), (1, 3, 5), (1, 9, 13), (2, 1, 8), (2, 7, 5)]
    entries = [tuple({"line": a, "column": b, "size": n, "column_utf16": 1}.get(c, "") for c in [*incremental._KEPT, "size"]) for a, b, n in places]
    f = spark.createDataFrame([("é😀x needle 😀\nneedle\n\nend", entries)], f"content string, entries array<{incremental.ENTRY}>")
    got = f.select(incremental.matched_in(F.col("content"), F.col("entries")).alias("e")).first()["e"]
    assert [e["matched"] for e in got] == ["needle", "😀x ne", "needle 😀\nneed", "needle\n\n", "\n\nend"]


def test_lcov_records_are_cut_in_place(spark):
    texts = ["DA:1,1|SF: a\\b |DA:1,0|DA: 2 , 3|DA:x|SF:c|LF:9|LH:4|LF:7|DA:5,0|end_of_record|DA:8,8|SF:|DA:1,1|end_of_record", "SF:a/b|DA:1,2|  end_of_record |SF:d|DA:4,0", "", "TN:"]
    got = R.lcov(spark.createDataFrame([(t.split("|"),) for t in texts], "lines array<string>"))
    assert sorted(map(tuple, got.collect())) == [("a/b", 2, 2), ("c", 9, 4), ("d", 1, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Join" not in plan


def test_tasks_grow_in_number_with_the_input(spark, tmp_path):
    from auditlake.session import by_size

    spark.range(1 << 20).select("id", F.rand(1).alias("x")).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    assert by_size(d, "id", megabytes=1).rdd.getNumPartitions() > 8 and by_size(d, "id", megabytes=64).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert by_size(d, "id", megabytes=1).count() == 1 << 20


def test_json_report_as_a_file(spark, report, files, tmp_path):
    """The file is the text that the driver would make; its entries are read by pieces of any size."""
    clean = scan.Scanner(spark, RULES).scan(files({"é\n{ \"x.txt": "nothing"}))
    for k, (some, least) in enumerate([(report, None), (report, "error"), (clean, None)]):
        p = tmp_path / f"{k}.json"
        where = sinks.write_json_report(some, p, least=least)
        text = sinks.json_report(some, least=least)
        assert p.read_text(encoding="utf-8") == text
        d = json.loads(text)
        for name, (start, end) in where.items():
            for piece in (9, 1 << 20):
                got = [r["value"] for r in sinks.json_entries(spark, p, (start, end), 6 if name == "files" else 4, max(piece, (end - start) // 9 + 1)).collect()]
                if name == "files":
                    assert json.loads("{" + ",".join(got) + "}") == d["metrics"]["files"] and len(got) == len(d["metrics"]["files"])
                else:
                    assert [json.loads(x) for x in got] == d[name]
        rest = sinks.json_outline(p, where)
        assert rest["findings"] == rest["skipped"] == [] and rest["metrics"] == {**d["metrics"], "files": {}}
        read = R.read_report(spark, str(p))[0].where("status = 'new'").orderBy("path", "line", "rule_id").collect()
        assert R.findings_of(sinks.json_entries(spark, p, where["findings"]), "new").orderBy("path", "line", "rule_id").collect() == read
