import json

import pytest

from auditlake.cli import main, safe
from auditlake.config import NAME, ConfigError, load
from auditlake.rulesets.convert import convert
from auditlake.rulesets.loader import load_text


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.yaml").write_text("version: 1\nrules:\n  - {id: t.word, severity: error, message: A word., regex: {pattern: needle}}\n")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x\n needle\n")
    (tmp_path / "src" / "bad").write_bytes(b"\xff")
    (tmp_path / "src" / "left.log").write_text("needle")
    (tmp_path / "src" / ".gitignore").write_text("*.log\n")
    return tmp_path


def run(spark, tree, *args):
    return main([args[0], str(tree / "src"), "--rules", str(tree / "rules"), "--no-default-rules", *args[1:]], spark)


def test_scan_baseline_and_rescan(spark, tree, capsys):
    assert run(spark, tree, "scan") == 1
    said = capsys.readouterr()
    assert said.out.startswith("a.py:2:2 error t.word A word.\n") and "ignored 1 file" in said.out and "skipped bad: not valid UTF-8" in said.err
    assert run(spark, tree, "baseline") == 0 and run(spark, tree, "scan", "--format", "json", "--no-gitignore") == 1
    out = capsys.readouterr().out
    data = json.loads(out[out.index("{") :])
    assert [f["path"] for f in data["findings"]] == ["left.log"] and [f["path"] for f in data["baselined"]] == ["a.py"] and data["ignored"] == {"files": 0, "directories": 0}
    assert run(spark, tree, "scan", "--format", "sarif") == 0
    assert json.loads(capsys.readouterr().out)["runs"][0]["results"] == []


def test_cache_and_dry_run(spark, tree, capsys):
    folder = str(tree / "state" / "cache")
    for _ in range(2):
        assert run(spark, tree, "scan", "--cache", folder) == 1
        assert capsys.readouterr().out.startswith("a.py:2:2 error t.word A word.\n")
    assert (tree / "state" / "cache.salt").stat().st_mode & 0o777 == 0o600
    assert main(["cache", folder, "--prune-days", "5"], spark) == 0 and capsys.readouterr().out == "0 days dropped\n2 entries of 1 days\n"
    assert run(spark, tree, "baseline", "--dry-run") == 0 and "1 findings would be added, 0 dropped" in capsys.readouterr().out
    assert not (tree / "src" / "auditlake-baseline.json").exists() and safe("a\x1b[2J\u202e") == "a\\x1b[2J\\u{202e}"


def test_links_out_of_the_configuration_are_refused(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "link").symlink_to(tmp_path / "out")
    (tmp_path / "in" / "own").symlink_to(tmp_path / "in")
    for text, ok in (('source_roots = ["link"]', False), ('rules = ["link/x"]', False), ('[silos]\na = ["link/**"]', False), ('[silos]\na = ["*/link"]\nb = ["own/*"]', True)):
        (tmp_path / "in" / NAME).write_text(text)
        if ok:
            assert len(load(tmp_path / "in" / NAME).silos) == 2
        else:
            with pytest.raises(ConfigError):
                load(tmp_path / "in" / NAME)


def test_expectations(spark, tree):
    assert run(spark, tree, "test") == 1
    (tree / "src" / "left.log").unlink()
    (tree / "src" / "a.py").write_text("# auditlake-expect: t.word\nneedle\n")
    assert run(spark, tree, "test") == 0


def test_refusals(spark, tree, capsys):
    assert main(["scan", str(tree / "none")], spark) == 2 and run(spark, tree, "scan", "--baseline", str(tree / "none.json")) == 2
    assert main(["scan", str(tree / "src"), "--no-default-rules"], spark) == 2
    (tree / "rules" / "b.yaml").write_text("version: 3\nrules: []\n")
    assert run(spark, tree, "scan") == 2
    assert "no rules" in (err := capsys.readouterr().err) and "version" in err


def test_convert():
    text, skipped = convert("""
[[rules]]
id = "One Two"
description = "d"
regex = '''\\b(ab[0-9]{4})\\b'''
entropy = 2
keywords = ["ab"]
[[rules.allowlists]]
regexes = ["^ab0"]
stopwords = ["x"]
[[rules]]
id = "look"
regex = "(?=a)"
[[rules]]
id = "none"
path = "x"
""")
    rules = load_text(text).rules
    assert [(r.id, r.group, r.entropy, r.keywords, r.allow_patterns, r.stopwords) for r in rules] == [("secrets.one-two", 1, 2.0, ("ab",), ("^ab0",), ("x",))]
    assert [n for n, _ in skipped] == ["look", "none"]
