"""Scans of files as they arrive.

A content-addressed side table keeps the findings of files that were scanned, one row for each key: rules, path scope,
parse limit, path and content. A file whose key is there isn't scanned again. An entry holds no matched text, which is
read from the file again, and a tag over its rows with a salt that only the table's owner has; a row whose tag is wrong
counts as missing. So a lost or damaged table costs time and never changes a result.
"""

from __future__ import annotations

import functools
import secrets
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..model import FINDING_COLUMNS
from ..operators import markers, matching, syntax
from ..plans.scan import with_status
from ..rulesets.loader import RuleSet
from ..session import checkpointed, discard
from ..sources.files import classified

VERSION = "2"
_KEPT = [c for c in FINDING_COLUMNS if c not in ("path", "matched")]
ENTRY = "struct<" + ", ".join(f"{c}: {'bigint' if c in ('line', 'column', 'column_utf16') else 'string'}" for c in _KEPT) + ", size: bigint>"
CACHE = f"key string, entries array<{ENTRY}>, tag string, day date"


def keyed(files: DataFrame, rules: RuleSet, scope: str = "scan-root", max_bytes: int = 2 << 20) -> DataFrame:
    """Files with the hash of what their findings depend on."""
    return files.withColumn("key", X.scope_hash(F.lit(VERSION), F.lit(rules.digest()), F.lit(scope), F.lit(str(max_bytes)), "path", X.content_hash("content")))


def tag(salt: str) -> Column:
    """What proves that the owner of the salt wrote a row."""
    return X.scope_hash(F.lit(salt), "key", F.to_json("entries"), F.lit(salt))


def matched_in(content: Column, entries: Column) -> Column:
    """Entries with the text they matched: ``size`` characters from a line and byte column on. The content is cut into lines once for all of them."""

    def cut(text: Column, e: Column) -> Column:
        """By bytes first, as a search by characters would pass over all of a long line for each entry."""
        some = F.substring(text.cast("binary"), e["column"].cast("int"), (e["size"] * 4).cast("int")).cast("string")
        return F.substring(some, F.lit(1), e["size"].cast("int"))

    def text(lines: Column, e: Column) -> Column:
        inside = cut(F.get(lines, (e["line"] - 1).cast("int")), e)
        beyond = cut(F.array_join(F.slice(lines, e["line"].cast("int"), (e["size"] + 1).cast("int")), "\n"), e)
        return F.when(F.length(inside) == e["size"], inside).otherwise(beyond)

    every = F.transform(F.array(F.split(content, "\n", -1)), lambda lines: F.transform(entries, lambda e: F.struct(*(e[c].alias(c) for c in _KEPT), text(lines, e).alias("matched"))))
    return F.get(every, F.lit(0))


def scan_batch(files: DataFrame, rules: RuleSet, cache: DataFrame | None = None, salt: str = "", scope: str = "scan-root", max_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """(findings of the files by all rules that look at one file, rows for the cache of those that had to be scanned)."""
    k = keyed(matching.with_language(files.where(F.col("path").isNotNull() & F.col("content").isNotNull())), rules, scope, max_bytes)
    known = None if cache is None else cache.where(F.col("tag") == tag(salt)).select("key", "entries").dropDuplicates(["key"])
    fresh = (k if known is None else k.join(known.select("key"), "key", "left_anti")).dropDuplicates(["key"])
    engines = []
    if some := rules.of("regex", "secret"):
        engines.append(matching.findings(fresh, some, ("key",)))
    if some := rules.of("ast"):
        engines.append(syntax.findings(fresh, some, max_bytes, ("key",)))
    row = F.struct(*_KEPT, F.length("matched").cast("long").alias("size"))
    if engines:
        by_key = functools.reduce(DataFrame.unionByName, engines).groupBy("key").agg(F.sort_array(F.collect_list(row)).alias("entries"))
        scanned = fresh.select("key").join(by_key, "key", "left").select("key", F.coalesce("entries", F.array().cast(f"array<{ENTRY}>")).alias("entries"))
    else:
        scanned = fresh.select("key", F.array().cast(f"array<{ENTRY}>").alias("entries"))
    scanned = checkpointed(scanned)  # both results are made of it: files are scanned once
    every = scanned if known is None else known.unionByName(scanned)
    found = k.join(every.where(F.size("entries") > 0), "key").select("path", F.explode(matched_in(F.col("content"), F.col("entries"))).alias("e")).select("path", "e.*")
    return found.select(*FINDING_COLUMNS), scanned.withColumn("tag", tag(salt)).withColumn("day", F.current_date())


class Cache:
    """The side table of one rule owner: Parquet in a shared folder, in parts that are written once and never changed, by day."""

    def __init__(self, spark: SparkSession, folder: str, salt: str | None = None):
        self.spark, self.folder, self.salt = spark, folder.rstrip("/"), salt or secrets.token_hex(16)

    def _exists(self, path: str) -> bool:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)

    def read(self, but: str | None = None) -> DataFrame:
        """All rows, or those of all parts but one."""
        if not self._exists(self.folder):
            return self.spark.createDataFrame([], CACHE)
        rows = self.spark.read.schema(f"{CACHE}, part string").parquet(self.folder)
        return (rows if but is None else rows.where(F.col("part") != but)).drop("part")

    def write(self, rows: DataFrame, part: str) -> None:
        """Adds rows under a name of their own; the same name again replaces them, so a batch may be run again."""
        rows.drop("day").write.mode("overwrite").parquet(f"{self.folder}/day={date.today().isoformat()}/part={part}")

    def days(self) -> list[str]:
        return [r["day"].isoformat() for r in self.read().select("day").distinct().orderBy("day").collect()] if self._exists(self.folder) else []

    def prune(self, days: int, today: date | None = None) -> int:
        """Drops what was written more than ``days`` days ago, whole days at a time; how many of these there were."""
        last = ((today or date.today()) - timedelta(days=days)).isoformat()
        old = [d for d in self.days() if d < last]
        for d in old:
            discard(self.spark, f"{self.folder}/day={d}")
        return len(old)


def scan(files: DataFrame, rules: RuleSet, cache: Cache, part: str, scope: str = "scan-root") -> DataFrame:
    """Findings of the files, of which those that the cache knows aren't scanned; what was scanned is added to it."""
    found, rows = scan_batch(files, rules, cache.read(part), cache.salt, scope)  # a part that is replaced isn't read
    cache.write(rows, part)
    return found


def watch(spark: SparkSession, folder: str, rules: RuleSet, out: str, checkpoint: str, glob: str = "*", cache: Cache | None = None) -> StreamingQuery:
    """Scans files of a folder as they come, with ``status`` by their markers; findings go to ``out`` by batch, and what was scanned to the cache. Runs until it has caught up."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return watch_files(classified(raw.select("path", F.col("content").alias("bytes"))).where("kind = 'text'").select("path", "content"), rules, out, checkpoint, cache)


def watch_files(files: DataFrame, rules: RuleSet, out: str, checkpoint: str, cache: Cache | None = None) -> StreamingQuery:
    """The same for a stream of (path, content). A batch that is run again replaces what it wrote."""

    def one(batch: DataFrame, number: int) -> None:
        found = scan_batch(batch, rules)[0] if cache is None else scan(batch, rules, cache, f"{number}")
        with_status(found, markers.suppressions(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_minute(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Findings per minute and severity of a stream (or table) with ``ts`` and ``severity``; what is later than ``delay`` is left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute").alias("w"), "severity").agg(F.count(F.lit(1)).alias("findings")).select(F.col("w.start").alias("minute"), "severity", "findings")
