"""Duplicate blocks: windows of lines that files share, grown to maximal blocks.

Windows are grouped natively by digest. Which of them become blocks depends on order (a line belongs to one block only).
But a block only ever takes lines of a segment: a run of repeated windows in one file of which each overlaps the next. And
segments that are equal in full fare alike, as soon as there are two: whatever the first takes, the others take at the
same place. So each distinct segment is resolved with two copies at most, in a greedy pass per connected group of segments
that share windows, and what became of it is then joined to all its copies. A header that all files share is one segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.paths import matches_any
from ..model import FINDING_COLUMNS
from ..rulesets.loader import RESERVED, Rule
from ..session import checkpointed
from .components import components

MIN_LINES = 10
LISTED = 10


def tokens(files: DataFrame) -> DataFrame:
    """(path, tok, line, text): the lines that aren't blank, trimmed of Unicode white space and numbered."""
    numbered = F.transform(X.lines("content"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), F.regexp_replace(x, r"(?U)^\s+|\s+\z", "").alias("text")))
    return files.select("path", F.posexplode(F.filter(numbered, lambda s: s["text"] != "")).alias("tok", "s")).select("path", F.col("tok").cast("long").alias("tok"), "s.line", "s.text")


def windows(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(path, tok, line, last_line, window): every run of ``min_lines`` such lines in a file, with its digest. Built from each file's own array, without a shuffle."""
    numbered = F.transform(X.lines("content"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), F.regexp_replace(x, r"(?U)^\s+|\s+\z", "").alias("text")))
    held = files.select("path", F.filter(numbered, lambda s: s["text"] != "").alias("t")).where(F.size("t") >= min_lines)
    at = held.select("path", "t", F.transform("t", lambda s: F.unhex(F.sha2(s["text"], 256))).alias("h")).select(
        "path", "t", "h", F.explode(F.sequence(F.lit(0), F.size("t") - min_lines)).alias("tok")
    )
    digest = F.unhex(F.sha2(F.aggregate(F.slice("h", F.col("tok") + 1, min_lines), F.lit(b""), lambda a, x: F.concat(a, x)), 256))
    return at.select(
        "path", F.col("tok").cast("long").alias("tok"), F.get("t", F.col("tok"))["line"].alias("line"), F.get("t", F.col("tok") + (min_lines - 1))["line"].alias("last_line"),
        F.substring(digest, 1, 16).alias("window"),
    )


def repeated(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The windows that occur more than once, with how often (``copies``)."""
    w = windows(files, min_lines)
    often = w.groupBy("window").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return w.join(often, "window")


def covered_lines(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(path, duplicated_lines): distinct lines in repeated windows."""
    t = tokens(files).select("path", "line", "tok")
    r = repeated(files, min_lines).select("path", F.explode(F.sequence("tok", F.col("tok") + (min_lines - 1))).alias("tok")).distinct()
    return r.join(t, ["path", "tok"]).groupBy("path").agg(F.countDistinct("line").alias("duplicated_lines"))


def greedy(rows: list[tuple[str, int, int, str]], min_lines: int) -> Iterator[tuple[str, int, str, int, int]]:
    """(block, lines, path, first line, last line) from tokens (path, tok, line, text) in order; gaps in ``tok`` end a run as a file's end does."""
    path, tok, line, text = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
    total = len(rows)
    run = [0] * total  # tokens from here to the end of the run
    for i in range(total - 1, -1, -1):
        run[i] = run[i + 1] + 1 if i + 1 < total and path[i + 1] == path[i] and tok[i + 1] == tok[i] + 1 else 1
    groups: dict[tuple, list[int]] = {}
    key = [tuple(text[i : i + min_lines]) if run[i] >= min_lines else None for i in range(total)]
    for i, k in enumerate(key):
        if k is not None:
            groups.setdefault(k, []).append(i)
    used = [False] * total
    for start in range(total):
        if used[start] or key[start] is None:
            continue
        group = [o for o in groups[key[start]] if o >= start and not any(used[o : o + min_lines])]
        if len(group) < 2:
            continue
        size = min_lines
        while size < run[start] and not used[start + size] and all(size < run[o] and not used[o + size] and text[o + size] == text[start + size] for o in group):
            size += 1
        chosen: list[int] = []
        for o in group:
            if not chosen or o >= chosen[-1] + size:
                chosen.append(o)
        if len(chosen) < 2:
            continue
        block = hashlib.sha256("\n".join(text[start : start + size]).encode("utf-8", "surrogatepass")).hexdigest()[:12]
        for o in chosen:
            used[o : o + size] = [True] * size
            yield block, size, path[o], line[o], line[o + size - 1]


def _segments(r: DataFrame, min_lines: int) -> DataFrame:
    """(path, first, content): each run of repeated windows that overlap, with its first token and a digest of where its windows stand."""
    before = Window.partitionBy("path").orderBy("tok")
    opens = r.withColumn("opens", (F.col("tok") - F.lag("tok").over(before) >= min_lines).cast("int"))
    numbered = opens.withColumn("n", F.coalesce(F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    by = numbered.groupBy("path", "n").agg(F.min("tok").alias("first"), F.sort_array(F.collect_list(F.struct("tok", "window"))).alias("ws"))
    inside = F.transform("ws", lambda x: F.struct((x["tok"] - F.col("first")).alias("at"), F.hex(x["window"]).alias("w")))
    return by.select("path", "first", F.sha2(F.to_json(inside), 256).alias("content"), F.size("ws").alias("size"), "ws")


def copies(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(block, line_count, first, path, start_line, end_line): every copy of every block; ``first`` names the block's first copy."""
    r = checkpointed(repeated(files, min_lines).select("path", "tok", "line", "last_line", "window"))
    every = _segments(r, min_lines)
    segments = checkpointed(every.select("path", "first", "content", (F.element_at("ws", -1)["tok"] + min_lines).alias("behind")))
    # the first two segments of each content, by aggregation, as there may be any number
    place = F.struct("path", "first", "behind")
    one = segments.groupBy("content").agg(F.min(place).alias("p"))
    two = segments.join(one, "content").where(place > F.col("p")).groupBy("content").agg(F.min(place).alias("p"))
    chosen = checkpointed(one.withColumn("leads", F.lit(True)).unionByName(two.withColumn("leads", F.lit(False))).select("content", "leads", "p.*"))
    inside = chosen.select("path", "content", "leads", F.col("first").alias("from"), F.explode(F.sequence("first", F.col("behind") - 1)).alias("tok"))
    windows_of = inside.join(r.select("path", "tok", "window"), ["path", "tok"]).select("content", "window").distinct()
    named = windows_of.groupBy("window").agg(F.min("content").alias("b"))
    member = components(windows_of.join(named, "window").select(F.col("content").alias("a"), "b").distinct()).select(F.col("node").alias("content"), F.col("root").alias("component"))
    held = tokens(files.join(chosen.select("path").distinct(), "path", "left_semi"))
    rows = inside.join(held, ["path", "tok"]).join(member, "content", "left").select(F.coalesce("component", "content").alias("component"), "content", "leads", "from", "path", "tok", "text")

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(order=part["path"].map(lambda p: p.encode())).sort_values(["order", "tok"])
        # the token's number stands in for its line, which differs from copy to copy
        found = greedy(list(zip(part["path"], part["tok"], part["tok"], part["text"])), min_lines)
        at = {(p, t): (c, f) for p, t, c, f, leads in zip(part["path"], part["tok"], part["content"], part["from"], part["leads"]) if leads}
        out = [(block, size, *at[path, start], start) for block, size, path, start, _ in found if (path, start) in at]
        return pd.DataFrame([(b, n, c, s - f) for b, n, c, f, s in out], columns=["block", "line_count", "content", "offset"])

    found = rows.groupBy("component").applyInPandas(resolve, "block string, line_count long, content string, offset long")
    placed = segments.join(found, "content").select("block", "line_count", "path", (F.col("first") + F.col("offset")).alias("tok"))
    starts, ends = r.select("path", "tok", F.col("line").alias("start_line")), r.select("path", F.col("tok").alias("end"), F.col("last_line").alias("end_line"))
    lined = checkpointed(placed.withColumn("end", F.col("tok") + F.col("line_count") - min_lines).join(starts, ["path", "tok"]).join(ends, ["path", "end"]))
    first = lined.groupBy("block", "line_count").agg(F.min(F.struct("path", "start_line")).alias("first"))
    return lined.join(first, ["block", "line_count"]).select("block", "line_count", "first", "path", "start_line", "end_line")


def duplicated_lines(files: DataFrame, min_lines: int = MIN_LINES, found: DataFrame | None = None) -> DataFrame:
    """(path, duplicated_lines): distinct lines (blank ones left out) in blocks."""
    found = copies(files, min_lines) if found is None else found
    t = tokens(files)
    return (
        t.join(found.select("path", "start_line", "end_line"), "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
        .groupBy("path").agg(F.countDistinct("line").alias("duplicated_lines"))
    )


def block_findings(found: DataFrame) -> DataFrame:
    """One info finding per copy; its message lists at most ten of the other copies."""
    place = F.concat("path", F.lit(":"), F.col("start_line").cast("string"))
    # only the first places of a block travel; a filter on the rank limits them before the shuffle
    ordered = Window.partitionBy("block", "first").orderBy("path", "start_line")
    few = found.select("block", "first", "path", "start_line", place.alias("place")).withColumn("k", F.row_number().over(ordered)).where(F.col("k") <= LISTED + 1)
    listed = few.groupBy("block", "first").agg(F.sort_array(F.collect_list(F.struct("k", "place"))).alias("listed"))
    size = found.groupBy("block", "first").agg(F.count(F.lit(1)).alias("n"))
    some = found.join(listed.join(size, ["block", "first"]), ["block", "first"]).withColumn("own", place)
    others = F.transform(F.slice(F.filter(F.col("listed"), lambda s: s["place"] != F.col("own")), 1, LISTED), lambda s: s["place"])
    hidden = F.col("n") - 1 - F.size("others")
    rows = some.withColumn("others", others).select(
        F.lit(RESERVED).alias("rule_id"), F.lit("info").alias("severity"),
        F.concat(F.lit("duplicated block, also at "), F.array_join("others", ", "), F.when(hidden > 0, F.concat(F.lit(", and "), hidden.cast("string"), F.lit(" more"))).otherwise("")).alias("message"),
        "path", F.col("start_line").alias("line"), F.lit(1).cast("long").alias("column"), F.lit(1).cast("long").alias("column_utf16"),
        F.concat(F.col("line_count").cast("string"), F.lit(" duplicated lines (block "), "block", F.lit(")")).alias("matched"), "block",
    )
    # as blocks go by (block, first copy), copies of one text in one file are counted in that order
    count = Window.partitionBy("path", "matched").orderBy("block", "line")
    return rows.withColumn("occurrence", F.row_number().over(count) - 1).withColumn("fingerprint", X.fingerprint("rule_id", "path", "matched", "occurrence")).select(*FINDING_COLUMNS)


def _gate(rule: Rule, rows: DataFrame, path: str, identity: str) -> DataFrame:
    """Findings for rows (path, identity, lines, dup) whose density exceeds the rule's limit."""
    d = F.when(F.col("lines") == 0, F.lit(0.0)).otherwise(X.percent("dup", "lines"))
    return rows.where(d > rule.limit).select(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.message).alias("message"), F.col(path).alias("path"),
        *(F.lit(1).cast("long").alias(c) for c in ("line", "column", "column_utf16")),
        F.concat(F.when(F.col(identity) != "", F.concat(identity, F.lit(": "))).otherwise(""), F.lit("density "), X.one_decimal(d), F.lit(f"% (max {rule.limit:.1f}%)")).alias("matched"),
        X.fingerprint(F.lit(rule.id), F.col(path), F.col(identity), F.lit(0)).alias("fingerprint"),
    )


def gate(rule: Rule, metrics: DataFrame, silos: DataFrame | None = None) -> DataFrame:
    """Density gate over metrics (path, lines, duplicated_lines), per scan, file or silo; unclaimed files are in no silo."""
    m = metrics
    if rule.include:
        m = m.where(matches_any("path", list(rule.include)))
    if rule.exclude:
        m = m.where(~matches_any("path", list(rule.exclude)))
    total = lambda d: d.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("duplicated_lines"), F.lit(0)).alias("dup"))
    if rule.scope == "file":
        return _gate(rule, m.select("path", F.lit("").alias("identity"), "lines", F.col("duplicated_lines").alias("dup")), "path", "identity")
    if rule.scope == "scan":
        return _gate(rule, total(m).select(F.lit(".").alias("path"), F.lit("").alias("identity"), "lines", "dup"), "path", "identity")
    if silos is None:
        raise ValueError(f"rule {rule.id}: a gate by silo needs silos")
    by = m.join(silos, "path").groupBy("silo").agg(F.sum("lines").alias("lines"), F.sum("duplicated_lines").alias("dup"))
    return _gate(rule, by.select(F.lit(".").alias("path"), F.concat(F.lit("silo "), "silo").alias("identity"), "lines", "dup"), "path", "identity")
