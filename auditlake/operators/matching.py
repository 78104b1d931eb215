"""Regex and secret rules over a table of files.

Rules that report their whole match run inside the JVM: matches and the gaps between them give every offset. Rules with
capture groups, and all secret rules, need match positions that Spark's functions don't give; they run over Arrow batches
in Python, on the files that a native filter by keyword leaves.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.languages import detect
from ..functions.paths import matches_any, python_glob
from ..model import FINDING, FINDING_COLUMNS
from ..rulesets.loader import Rule, compiled, java_pattern
from ..session import spread

_SPACE = re.compile(r"\s+")
_SIGNS = "_-.:/~0123456789"  # rare in prose


def applies(rule: Rule, path: Column | str = "path", language: Column | str = "language") -> Column:
    """The rule's envelope: language listed (an unknown one fails), included, not excluded."""
    out = F.lit(True)
    if rule.languages:
        out = out & F.coalesce((F.col(language) if isinstance(language, str) else language).isin(*rule.languages), F.lit(False))
    if rule.include:
        out = out & matches_any(path, list(rule.include))
    if rule.exclude:
        out = out & ~matches_any(path, list(rule.exclude))
    return out


def with_language(files: DataFrame) -> DataFrame:
    return files if "language" in files.columns else files.withColumn("language", detect("path", "content"))


def has_keyword(rule: Rule, content: Column | str = "content") -> Column:
    """Whether the file holds one of a secret rule's keywords, in any case."""
    low = F.lower(F.col(content) if isinstance(content, str) else content)
    return functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in rule.keywords)) if rule.keywords else F.lit(True)


def can_match(rules: list[Rule]) -> Column:
    """Whether a file is in the envelope of some rule and holds one of its keywords. The content is lowered once for all rules of an envelope."""
    envelopes: dict[tuple, list[Rule]] = {}
    for r in rules:
        envelopes.setdefault((r.languages, r.include, r.exclude), []).append(r)
    out = F.lit(False)
    for some in envelopes.values():
        words = sorted({w for r in some for w in r.keywords}, key=len)
        least = [w for k, w in enumerate(words) if not any(v in w for v in words[:k])]
        held = F.exists(F.array(F.lower("content")), lambda low: F.exists(F.array(*map(F.lit, least)), lambda w: F.contains(low, w)))  # noqa: B023
        out = out | (applies(some[0]) & held if all(r.keywords for r in some) else applies(some[0]))
    return out


def is_native(rule: Rule) -> bool:
    """Whether a rule runs inside the JVM: whole matches only, and never an empty one."""
    return rule.kind == "regex" and rule.group == 0 and compiled(rule.pattern).search("") is None and not re.search(r"\\[bBA]|\^|\$|\\x\{", rule.pattern)


def native_findings(files: DataFrame, rules: list[Rule], carry: tuple[str, ...] = ()) -> DataFrame:
    """Findings of whole-match rules, from one scan of the files; ``carry`` names columns of the files to hand on.

    The matches of a text and the gaps between them are its parts in order; each pattern runs once over every text, and
    again, for the gaps, over those that it matches. Each part is reduced to numbers (bytes, UTF-16 units, line feeds, and
    how much follows the last of these), and running sums over the parts of a row give every match its line and columns;
    texts themselves aren't carried along, and nothing grows with the square of the matches. Rows are told apart by a
    number of their own, so files may repeat a path.
    """
    files = with_language(files).where(F.col("path").isNotNull()).select("path", "language", "content", *carry).withColumn("__row", F.monotonically_increasing_id())

    def matches(rule: Rule) -> Column:
        return F.when(applies(rule), F.regexp_extract_all("content", F.lit(java_pattern(rule.pattern)), F.lit(0)))

    by_rule = files.select("*", F.posexplode(F.array(*(matches(r) for r in rules))).alias("k", "m")).where(F.size("m") > 0)
    gaps = None
    for k, r in enumerate(rules):
        cut = F.split("content", java_pattern(r.pattern), -1)
        gaps = F.when(F.col("k") == k, cut) if gaps is None else gaps.when(F.col("k") == k, cut)
    rows = by_rule.select("path", "__row", "k", *carry, F.posexplode(F.arrays_zip("m", gaps.alias("g"))).alias("i", "s"))
    rows = rows.select("path", "__row", "k", *carry, "i", F.col("s.m").alias("matched"), F.col("s.g").alias("gap")).where("matched IS NOT NULL")

    def feeds(x: str) -> Column:
        return F.length(x) - F.length(F.translate(x, "\n", ""))

    def units(x: Column) -> Column:
        return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("long")

    measured = rows.select(
        "path", "__row", "k", *carry, "i", "matched", feeds("gap").alias("gap_feeds"), feeds("matched").alias("own_feeds"),
        *(c for n, size in (("b", lambda x: F.octet_length(x).cast("long")), ("u", units)) for x in ("gap", "matched")
          for c in (size(F.col(x)).alias(f"{x}_{n}"), size(F.substring_index(x, "\n", -1)).alias(f"{x}_{n}_tail"))),
    )
    before = Window.partitionBy("__row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("__row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    placed = measured.withColumn("line", zero(F.sum("own_feeds").over(before)) + F.sum("gap_feeds").over(upto) + 1)
    for n, name in (("b", "column"), ("u", "column_utf16")):
        # where each part ends, and where its last line feed was, counted from the file's start
        placed = placed.withColumn("start", zero(F.sum(F.col(f"gap_{n}") + F.col(f"matched_{n}")).over(before)) + F.col(f"gap_{n}"))
        gap_feed = F.when(F.col("gap_feeds") > 0, F.col("start") - F.col(f"gap_{n}_tail"))
        own_feed = F.when(F.col("own_feeds") > 0, F.col("start") + F.col(f"matched_{n}") - F.col(f"matched_{n}_tail"))
        placed = placed.withColumn("gap_feed", gap_feed).withColumn("own_feed", own_feed)
        placed = placed.withColumn(name, F.col("start") - F.greatest(zero(F.max("gap_feed").over(upto)), zero(F.max("own_feed").over(before))) + 1)
    named = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message")) for r in rules))
    out = placed.withColumn("r", F.get(named, F.col("k"))).select("r.*", "path", "__row", "k", *carry, "matched", F.col("i").alias("offset"), *(F.col(c).cast("long").alias(c) for c in ("line", "column", "column_utf16")))
    return finish(out, carry)


def finish(found: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``found`` has the row's number and the rule's, ``k``. Occurrence numbers (in match order, among equal texts of a rule in a file) and fingerprints."""
    same = Window.partitionBy("__row", "k", X.normalize_space("matched")).orderBy("offset")
    numbered = found.withColumn("occurrence", F.row_number().over(same) - 1)
    return numbered.withColumn("fingerprint", X.fingerprint("rule_id", "path", "matched", "occurrence")).select(*FINDING_COLUMNS, *carry)


def byte_entropy(value: str) -> float:
    raw = value.encode("utf-8", "surrogatepass")
    return -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values()) if raw else 0.0


def fingerprint(rule_id: str, path: str, matched: str, occurrence: int) -> str:
    return hashlib.sha256(b"\0".join(x.encode("utf-8", "surrogatepass") for x in (rule_id, path, _SPACE.sub(" ", matched).strip(), str(occurrence)))).hexdigest()


def position(content: str, offset: int) -> tuple[int, int, int]:
    """(line, byte column, UTF-16 column), all from 1, of a character offset."""
    start = content.rfind("\n", 0, offset) + 1
    tail = content[start:offset]
    return content.count("\n", 0, offset) + 1, len(tail.encode("utf-8", "surrogatepass")) + 1, len(tail.encode("utf-16-le", "surrogatepass")) // 2 + 1


def spans(rule: Rule, content: str) -> Iterator[tuple[int, int]]:
    """Spans that a rule reports: of its group, where it took part, that pass the gates of secret rules."""
    for m in compiled_once(rule.pattern).finditer(content):
        a, b = m.span(rule.group)
        if a < 0:
            continue
        if rule.kind == "secret":
            value = content[a:b]
            if rule.entropy is not None and byte_entropy(value) < rule.entropy:
                continue
            if any(w in value.lower() for w in rule.stopwords) or any(compiled_once(p).search(value) for p in rule.allow_patterns):
                continue
        yield a, b


@functools.lru_cache(maxsize=4096)
def compiled_once(pattern: str):
    return compiled(pattern)


@functools.lru_cache(maxsize=4096)
def _glob(g: str):
    return python_glob(g)


def _in_envelope(rule: Rule, path: str, language: str | None) -> bool:
    if rule.languages and language not in rule.languages:
        return False
    if rule.include and not any(_glob(g).match(path) for g in rule.include):
        return False
    return not any(_glob(g).match(path) for g in (*rule.exclude, *rule.allow_paths))


def keyword_tests(rules: list[Rule]) -> list[tuple[str, str | None, tuple[int, ...]]]:
    """(text, text that has to be there first, numbers of the rules it lets pass) for all keywords, short ones first: a keyword that holds another, or a rare sign, needn't be looked for without it."""
    by: dict[str, list[int]] = {c: [] for c in _SIGNS}
    for k, rule in enumerate(rules):
        for w in rule.keywords or ("",):
            by.setdefault(w, []).append(k)
    words = sorted(by, key=len)
    return [(w, max((v for v in words if v and v != w and v in w), key=len, default=None), tuple(by[w])) for w in words]


def file_findings(rules: list[Rule], path: str, language: str | None, content: str, tests: list | None = None) -> list[tuple]:
    """Findings of one file in order of offset, then of the rules; ``tests`` are the rules' :func:`keyword_tests`."""
    low, found, there, some = content.lower(), [], set(), set()
    for word, needed, ks in keyword_tests(rules) if tests is None else tests:
        if (needed is None or needed in there) and word in low:
            there.add(word)
            some.update(ks)
    for k in sorted(some):
        if _in_envelope(rules[k], path, language):
            found += [(a, k, content[a:b]) for a, b in spans(rules[k], content)]
    found.sort(key=lambda x: x[:2])
    out, seen = [], Counter()
    for a, k, matched in found:
        rule, key = rules[k], (k, _SPACE.sub(" ", matched).strip())
        out.append((rule.id, rule.severity, rule.message, path, *position(content, a), matched, fingerprint(rule.id, path, matched, seen[key])))
        seen[key] += 1
    return out


_ARROW = pa.schema([(f.name, pa.int64() if f.dataType.simpleString() == "bigint" else pa.string()) for f in FINDING])


def by_file(files: DataFrame, find: Callable[[str, str | None, str], list[tuple]], carry: tuple[str, ...] = ()) -> DataFrame:
    """The findings that ``find(path, language, content)`` gives for each file, over Arrow batches; columns named in ``carry`` are handed on."""
    slim = spread(files.select("path", "language", "content", *carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, origin = [], []
            for i, (path, language, content) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]))):
                some = find(path, language, content)
                rows += some
                origin += [i] * len(some)
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([*columns, *(c.take(pa.array(origin, pa.int64())) for c in b.columns[3:])], names=[*FINDING_COLUMNS, *carry])

    return slim.mapInArrow(run, T.StructType([*FINDING.fields, *(slim.schema[c] for c in carry)]))


def python_findings(files: DataFrame, rules: list[Rule], carry: tuple[str, ...] = ()) -> DataFrame:
    """Findings of rules that need match positions, in one pass over the files that can have any."""
    held = with_language(files).where(F.col("path").isNotNull() & F.col("content").isNotNull()).where(can_match(rules))
    tests = keyword_tests(rules)
    return by_file(held, lambda path, language, content: file_findings(rules, path, language, content, tests), carry)


def findings(files: DataFrame, rules: list[Rule], carry: tuple[str, ...] = ()) -> DataFrame:
    """Findings of all regex and secret rules."""
    files = with_language(files)
    native = [r for r in rules if is_native(r)]
    rest = [r for r in rules if r.kind in ("regex", "secret") and not is_native(r)]
    parts = ([native_findings(files, native, carry)] if native else []) + ([python_findings(files, rest, carry)] if rest or not native else [])
    return functools.reduce(DataFrame.unionByName, parts)
