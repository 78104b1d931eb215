import math
import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import languages, paths
from auditlake.functions import text as X


def values(spark, column, rows, kind="string"):
    d = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r[0] for r in d.orderBy("k").select(column).collect()]


def test_positions_count_bytes_and_utf16(spark):
    got = values(spark, F.struct(X.line_of("x"), X.column_of("x"), X.utf16_column_of("x")), ["", "ab", "a\né", "a\n😀"])
    assert [tuple(r) for r in got] == [(1, 1, 1), (1, 3, 3), (2, 3, 2), (2, 5, 3)]


def test_space_and_fingerprint(spark):
    assert values(spark, X.normalize_space("x"), [" a\t b\u00a0\u2003c\n", "", None]) == ["a b c", "", None]
    from auditlake.operators.matching import fingerprint

    got = values(spark, X.fingerprint(F.lit("a.b"), F.lit("p/q"), "x", F.lit(2)), ["x  y", "é"])
    assert got == [fingerprint("a.b", "p/q", "x  y", 2), fingerprint("a.b", "p/q", "é", 2)]
    assert got[0] == fingerprint("a.b", "p/q", " x y ", 2)


def test_sanitize(spark):
    got = values(spark, X.sanitize("x"), ["plain é", "a\x1b[0m\x7f", "a\u202eb\u2066", "\x85", "\n"])
    assert got == ["plain é", "a\\x1b[0m\\x7f", "a\\u{202e}b\\u{2066}", "\\x85", "\\x0a"]


def test_uri(spark):
    assert values(spark, X.uri_reference("x"), ["a b/c~d*e.f", "é/+%", "-_."]) == ["a%20b/c~d%2Ae.f", "%C3%A9/%2B%25", "-_."]


def test_entropy(spark):
    got = values(spark, X.entropy("x"), ["", "aaaa", "abab", "abcd", "é"])
    assert [round(v, 9) for v in got] == [0, 0, 1, 2, 1]


def test_lines(spark):
    assert values(spark, X.lines("x"), ["", "a", "a\n", "a\r\n\r\nb", "a\u2028b\n\n"]) == [[], ["a"], ["a"], ["a", "", "b"], ["a\u2028b", ""]]
    assert values(spark, X.count_lines("x"), ["", " \n\u00a0\n", "a\n\nb"]) == [0, 0, 2]


def test_one_decimal_rounds_as_c_does(spark):
    rnd = random.Random(1)
    xs = [0.0, 12.25, 12.35, 0.05, 0.25, 99.95, 100.0, 11288.95, -0.25, -1.35, *(rnd.random() * 100 for _ in range(300)), *(rnd.randrange(20000) / 80 for _ in range(300))]
    got = values(spark, X.one_decimal("x"), xs, "double")
    assert [g for g, x in zip(got, xs) if g != f"{x:.1f}" and f"{x:.1f}" != "-0.0"] == []


def test_small_ones(spark):
    assert values(spark, X.quantity("x", "file"), [0, 1, 2], "int") == ["0 files", "1 file", "2 files"]
    assert values(spark, X.severity_rank("x"), ["info", "warning", "error", "x", None]) == [0, 1, 2, None, None]
    assert values(spark, X.sarif_level("x"), ["info", "warning", "error"]) == ["note", "warning", "error"]
    assert values(spark, X.version_at_least("x", 1, 2), ["1.2", "1.10", "1.1", "2.0", "x", None]) == [True, True, False, True, False, False]
    assert values(spark, X.duplicate_text("x")[0], ["12 duplicated lines (block 0123456789ab)", "12 lines"]) == [12, None]
    assert values(spark, X.duplicate_text("x")[1], ["12 duplicated lines (block 0123456789ab)"]) == ["0123456789ab"]
    assert values(spark, X.is_coverage_text("x"), ["1/2 lines (50.0%)", "1/2 lines"]) == [True, False]
    assert values(spark, X.rating(F.col("x"), F.lit(1)), [0, 1, 5, 6, 20, 21], "int") == ["B", "C", "C", "D", "D", "E"]
    assert values(spark, X.coverage_percent("x", F.lit(0)), [1], "int") == [100.0]
    assert values(spark, X.density("x", F.lit(0)), [1], "int") == [0.0]


def test_path_algebra(spark):
    cases = [("a/b", "../c/./d"), ("", "../x"), ("a", ".."), ("a", "b//c"), ("", "a/../../b")]
    d = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, b string")
    got = [r[0] for r in d.orderBy("k").select(paths.joined("a", "b")).collect()]
    assert got == ["a/c/d", None, None, "a/b/c", None] == [paths.join_path(*c) for c in cases]
    assert values(spark, paths.top_dir("x"), ["a/b/c", "a", "/a"]) == ["a", ".", "."]
    assert values(spark, paths.family("x"), ["k8s/a", "a"]) == ["k8s", "core"]
    assert values(spark, paths.has_suffix("x", F.lit("b/c")), ["b/c", "a/b/c", "ab/c", "c"]) == [True, True, False, False]
    assert values(spark, paths.anchored("pre/", "x"), ["a"]) == ["pre/a"]
    assert values(spark, paths.normalized("x"), ["a\\b"]) == ["a/b"]
    assert paths.ascend("a/b/c", 2) == "a" and paths.ascend("a", 2) is None


@pytest.mark.parametrize(
    "glob,yes,no",
    [
        ("*.py", ["a.py", "a/b.py"], ["a.pyc"]), ("src/**", ["src/a", "src/a/b"], ["srcs/a"]), ("**/t/*", ["t/a", "x/y/t/a"], ["xt/a"]), ("a/**/b", ["a/b", "a/x/y/b"], ["a/xb"]),
        ("[a-c]?{x,yy}", ["a1x", "c2yy"], ["d1x", "a1z"]), ("[!a]x", ["bx"], ["ax"]), (r"a\*", ["a*"], ["ab"]), ("a.b", ["a.b"], ["axb"]), ("*\n", ["x\n"], ["x"]),
    ],
)
def test_globs(spark, glob, yes, no):
    assert all(paths.python_glob(glob).match(p) for p in yes) and not any(paths.python_glob(glob).match(p) for p in no)
    assert values(spark, paths.matches_any("x", [glob]), yes + no) == [True] * len(yes) + [False] * len(no)


def test_bad_globs():
    for g in ("[a", "{a", "a\\"):
        with pytest.raises(paths.GlobError):
            paths.glob_regex(g)


def test_languages(spark, files):
    d = files({"a.rs": "", "b/C.PY": "", ".env": "#!/usr/bin/python", "run": "#!/bin/bash\n", "x": "#!/usr/bin/env node", "y.txt": "#!/bin/sh", "z": "hi", "w.tsx": "", "q.rb": "", "s": "#!/usr/bin/ruby"})
    got = {r[0]: r[1] for r in d.select("path", languages.detect("path", "content")).collect()}
    assert got == {"a.rs": "rust", "b/C.PY": "python", ".env": "python", "run": "shell", "x": "javascript", "y.txt": None, "z": None, "w.tsx": "typescript", "q.rb": "ruby", "s": "ruby"}
    assert values(spark, languages.comment_prefix("x"), ["rust", "python", "shell", "x"]) == ["//", "#", "#", None]


def by_hand(source, language):
    """Code lines, character by character."""
    n, inside = 0, False
    for line in source.split("\n"):
        if language == "ruby":
            t = line.strip()
            if inside:
                inside = not t.startswith("=end")
            elif t.startswith("=begin"):
                inside = True
            elif t and not t.startswith("#"):
                n += 1
            continue
        code, i = False, 0
        while i < len(line):
            if inside:
                e = line.find("*/", i)
                if e < 0:
                    break
                inside, i = False, e + 2
            elif line.startswith("//", i):
                break
            elif line.startswith("/*", i):
                inside, i = True, i + 2
            else:
                code |= not line[i].isspace()
                i += 1
        n += code
    return n


def test_code_lines(spark):
    rnd = random.Random(3)
    for language, bits in (("rust", ["a", " ", "/*", "*/", "//", "\n", "/", "*", "x y"]), ("ruby", ["a", " ", "\n", "\n=begin", "\n=end", "#", "\n"])):
        sources = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(30))) for _ in range(200)]
        assert values(spark, languages.code_lines("x", F.lit(language)), sources) == [by_hand(s, language) for s in sources]
    assert values(spark, languages.code_lines("x", F.lit("python")), ["# a\nb\n\n  # c\nd # e"]) == [2]
    assert values(spark, languages.code_lines("x", F.lit("text")), ["a"]) == [None]
    assert values(spark, languages.code_lines("x", F.lit("c")), ["a" * 200_000 + "/*" + "b" * 200_000]) == [1]


def test_hashes(spark):
    import hashlib

    assert values(spark, X.content_hash("x"), ["é"]) == [hashlib.sha256("é".encode()).hexdigest()]
    assert values(spark, X.scope_hash(F.lit("a"), "x"), ["b"]) == [hashlib.sha256(b"a\0b").hexdigest()]
    assert math.isclose(values(spark, X.entropy("x"), ["aab"])[0], 0.9182958340544896)
