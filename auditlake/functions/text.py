"""Scalar expressions over text, all of them native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import RANK

NUL = b"\x00"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_space(x: Column | str) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def fingerprint(rule_id: Column | str, path: Column | str, matched: Column | str, occurrence: Column | str) -> Column:
    """SHA-256 over rule, path, normalised match and occurrence, NUL between them; positions aren't part of it."""
    parts = [_c(rule_id), _c(path), normalize_space(matched), _c(occurrence).cast("string")]
    joined: list[Column] = []
    for k, p in enumerate(parts):
        joined += [F.lit(NUL)] * (k > 0) + [p.cast("binary")]
    return F.sha2(F.concat(*joined), 256)


def line_of(prefix: Column | str) -> Column:
    """1-based line of what follows ``prefix``; only a line feed ends a line."""
    return (F.length(_c(prefix)) - F.length(F.translate(_c(prefix), "\n", "")) + 1).cast("long")


def _tail(prefix: Column | str) -> Column:
    return F.substring_index(_c(prefix), "\n", -1)


def column_of(prefix: Column | str) -> Column:
    """1-based column in bytes."""
    return (F.octet_length(_tail(prefix)) + 1).cast("long")


def utf16_column_of(prefix: Column | str) -> Column:
    """1-based column in UTF-16 units."""
    return (F.octet_length(F.encode(_tail(prefix), "UTF-16BE")) / 2 + 1).cast("long")


def severity_rank(x: Column | str) -> Column:
    """0 for info up to 2 for error; null for anything else."""
    out = F.lit(None).cast("int")
    for s, k in RANK.items():
        out = F.when(_c(x) == s, F.lit(k)).otherwise(out)
    return out


def sarif_level(x: Column | str) -> Column:
    return F.when(_c(x) == "error", "error").when(_c(x) == "warning", "warning").otherwise("note")


def quantity(n: Column | str, noun: str, plural: str | None = None) -> Column:
    return F.concat(_c(n).cast("string"), F.lit(" "), F.when(_c(n) == 1, noun).otherwise(plural or noun + "s"))


def sanitize(x: Column | str) -> Column:
    """Control characters as ``\\xNN``, bidirectional controls as ``\\u{NNNN}``, so that text can't steer a terminal."""
    steers = r"[\x00-\x1f\x7f-\u009f\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"

    def shown(c: Column) -> Column:
        code = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.when(F.startswith(code, F.lit("00")), F.concat(F.lit("\\x"), F.right(code, F.lit(2)))).otherwise(F.concat(F.lit("\\u{"), code, F.lit("}")))

    marks = F.transform(F.regexp_extract_all(_c(x), F.lit(f"({steers})"), F.lit(1)), shown)
    parts = F.split(_c(x), steers, -1)
    return F.when(~_c(x).rlike(steers), _c(x)).otherwise(F.array_join(F.zip_with(parts, marks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))


def uri_reference(path: Column | str) -> Column:
    """Each segment percent-encoded but for unreserved characters; slashes stay."""
    coded = F.url_encode(_c(path))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def entropy(x: Column | str) -> Column:
    """Shannon entropy of the bytes, in bits per byte; 0 for an empty string."""
    bytes_ = F.array_sort(F.filter(F.regexp_extract_all(F.hex(F.encode(_c(x), "UTF-8")), F.lit("(..)"), F.lit(1)), lambda b: b != ""))
    size = F.octet_length(_c(x)).cast("double")
    weight = lambda n: n * F.log2(n)
    # equal bytes follow each other: one pass over the runs
    start = F.struct(F.lit("").alias("last"), F.lit(1.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda a, b: F.when(
        a["last"] == b, F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))
    ).otherwise(F.struct(b.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + weight(a["run"])).alias("sum")))
    total = F.aggregate(bytes_, start, step, lambda a: a["sum"] + weight(a["run"]))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.log2(size) - total / size)


def lines(content: Column | str) -> Column:
    """Physical lines without their ends; no line follows a final line feed."""
    c = _c(content)
    cut = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(c == "", F.array().cast("array<string>")).when(F.endswith(c, F.lit("\n")), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def count_lines(content: Column | str) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(_c(content), "\n", -1), lambda x: x.rlike(r"(?U)\S"))).cast("long")


def density(duplicated: Column | str, total: Column | str) -> Column:
    return F.when(_c(total) == 0, F.lit(0.0)).otherwise(_c(duplicated) / _c(total) * 100.0)


def percent(part: Column | str, total: Column | str) -> Column:
    """A count's share as the double nearest to it: the product is exact, so that only the division rounds and ties of :func:`one_decimal` are ties."""
    return _c(part) * 100.0 / _c(total)


def coverage_percent(covered: Column | str, total: Column | str) -> Column:
    return F.when(_c(total) == 0, F.lit(100.0)).otherwise(percent(covered, total))


def rating(errors: Column | str, warnings: Column | str) -> Column:
    """Over new findings: A without errors or warnings, B with warnings only, C up to 5 errors, D up to 20, else E."""
    e, w = _c(errors), _c(warnings)
    return F.when(e > 20, "E").when(e > 5, "D").when(e > 0, "C").when(w > 0, "B").otherwise("A")


def duplicate_text(matched: Column | str) -> tuple[Column, Column]:
    """Lines and block key of a duplicate-block finding's text; null where it is no such text."""
    p = r"^(\d+) duplicated lines \(block ([0-9a-f]{12})\)$"
    hit = _c(matched).rlike(p)
    return F.when(hit, F.regexp_extract(_c(matched), p, 1).cast("long")), F.when(hit, F.regexp_extract(_c(matched), p, 2))


def is_coverage_text(matched: Column | str) -> Column:
    return _c(matched).rlike(r"^\d+/\d+ lines \(\d+\.\d%\)$")


def version_at_least(version: Column | str, major: int, minor: int) -> Column:
    a, b = (F.regexp_extract(_c(version), r"^(\d+)\.(\d+)$", k).try_cast("int") for k in (1, 2))
    return F.coalesce((a > major) | ((a == major) & (b >= minor)), F.lit(False))


def content_hash(content: Column | str) -> Column:
    return F.sha2(_c(content).cast("binary"), 256)


def scope_hash(*parts: Column | str) -> Column:
    """SHA-256 over strings with NUL between them."""
    joined: list[Column] = []
    for k, p in enumerate(parts):
        joined += [F.lit(NUL)] * (k > 0) + [_c(p).cast("binary")]
    return F.sha2(F.concat(*joined), 256)


def one_decimal(x: Column | str) -> Column:
    """A double with one decimal, rounded by its exact binary value, ties to even (as C's printf does)."""
    exact = _c(x).cast("double")
    scaled = exact * 10
    # what the product lost in rounding, by splitting the factor in two halves whose products are exact
    c = exact * 134217729.0
    high = c - (c - exact)
    lost = (high * 10 - scaled) + (exact - high) * 10
    low = F.floor(scaled)
    half = scaled - low
    up = F.when(half > 0.5, True).when(half < 0.5, False).when(lost != 0, lost > 0).otherwise(low % 2 != 0)
    tenth = (low + F.when(up, 1).otherwise(0)).cast("long")
    return F.concat(F.when(exact < 0, "-").otherwise(""), F.floor(F.abs(tenth) / 10).cast("string"), F.lit("."), (F.abs(tenth) % 10).cast("string"))
