"""Architecture boundaries: imports resolved to files, files to silos, and the edges that rules deny."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.paths import ascend, glob_regex, join_path
from ..functions.paths import parent as parent_column
from ..model import FINDING_COLUMNS
from ..rulesets.loader import Rule
from .matching import applies

SUFFIXES = {
    "javascript": tuple(front + end for front in ("", "/index") for end in ".js .ts .tsx .mjs".split()), "python": (".py", "/__init__.py"), "rust": (".rs", "/mod.rs"), "go": (".go",),
    "java": (".java",), "csharp": (".cs",), "ruby": (".rb",), "c": (), "cpp": (),
}
SUFFIXES["typescript"] = SUFFIXES["javascript"]
STAND_INS = {"go": ".go", "csharp": ".cs"}


def anchors(source_roots: list[str]) -> list[str]:
    """Where imports start: the configured roots in order, then the repository itself."""
    return list(dict.fromkeys([*(r.strip("/") for r in source_roots), ""]))


def _parent(path: str) -> str:
    return path.rpartition("/")[0]


def _module_dir(path: str) -> str:
    folder, name = _parent(path), path.rpartition("/")[2]
    stem = name[:-3] if name.endswith(".rs") else name
    return folder if stem in ("mod", "lib", "main") else f"{folder}/{stem}".lstrip("/")


def candidates(language: str, path: str, raw: str, roots: list[str], modules: list[tuple[str, str]]) -> list[str]:
    """Paths without extension that an import may mean, the likeliest first. ``modules`` are Go's (folder, module path), longest path first."""
    raw, out = raw.strip(), []

    def add(base: str | None, rel: str) -> None:
        if base is not None and (p := join_path(base, rel)) and p not in out:
            out.append(p)

    if not raw:
        return out
    folder = _parent(path)
    if language in ("javascript", "typescript"):
        if raw.startswith(("./", "../")):
            add(folder, raw)
    elif language in ("c", "cpp", "ruby"):
        for base in [folder, *roots]:
            add(base, raw)
    elif language == "python":
        dots = len(raw) - len(raw.lstrip("."))
        rest = raw[dots:].replace(".", "/")
        for base in [ascend(folder, dots - 1)] if dots else roots:
            add(base, rest)
    elif language == "rust":
        parts = [s for s in (x.strip() for x in raw.split("{")[0].split("::")) if s not in ("", "*")]
        if not parts:
            return out
        if parts[0] == "crate":
            k = path.rfind("/src/")
            base, parts = path[: k + 4] if k >= 0 else "src", parts[1:]
        elif parts[0] == "self":
            base, parts = _module_dir(path), parts[1:]
        elif parts[0] == "super":
            n = next((k for k, s in enumerate(parts) if s != "super"), len(parts))
            base, parts = ascend(_module_dir(path), n), parts[n:]
        else:
            return out
        for n in range(len(parts), 0, -1):
            add(base, "/".join(parts[:n]))
    elif language == "go":
        name = raw.strip("/")
        for base, module in modules:
            if name == module or name.startswith(module + "/"):
                add(base, name[len(module) :])
    elif language in ("java", "csharp"):
        parts = [s for s in (x.strip() for x in raw.split(".")) if s not in ("", "*")]
        for n in range(len(parts), max(len(parts) - 1, 1) - 1, -1):
            for base in roots:
                add(base, "/".join(parts[:n]))
    return out


def go_modules(files: DataFrame) -> DataFrame:
    """(folder, module) of every go.mod."""
    found = files.where(F.col("path").rlike(r"^(.*/)?go\.mod$")).select(parent_column("path").alias("folder"), F.regexp_extract("content", r"(?m)^[ \t]*module[ \t]+\"?([^\s\"]+)", 1).alias("module"))
    return found.where("module <> ''")


def _candidate_table(imports: DataFrame, source_roots: list[str], modules: list[tuple[str, str]]) -> DataFrame:
    """(path, position, language, priority, base): one row for each candidate."""
    roots = anchors(source_roots)
    schema = pa.schema([("path", pa.string()), ("position", pa.int64()), ("language", pa.string()), ("priority", pa.int32()), ("base", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n, g, k, c) for p, n, g, raw in zip(*(x.to_pylist() for x in b.columns)) for k, c in enumerate(candidates(g, p, raw, roots, modules))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return imports.select("path", "position", "language", "raw").mapInArrow(run, "path string, position long, language string, priority int, base string")


def resolve(imports: DataFrame, nodes: DataFrame, source_roots: list[str] | None = None, modules: DataFrame | None = None) -> DataFrame:
    """``imports`` with the file (``target``) that each means; those that mean none are left out.

    Every candidate is tried as it is, then with the language's suffixes, then (Go, C#) as a folder whose first file
    stands in; the first that is a node wins. All of it is one equi-join on paths.
    """
    known = sorted(((r["folder"], r["module"]) for r in modules.distinct().collect()), key=lambda m: (-len(m[1]), m[1], m[0])) if modules is not None else []
    base = _candidate_table(imports, source_roots or [], known)
    suffixes = F.lit(None).cast("array<string>")
    for language, some in SUFFIXES.items():
        suffixes = F.when(F.col("language") == language, F.array(*(F.lit(s) for s in ("", *some)))).otherwise(suffixes)
    tried = base.select("path", "position", "priority", "base", F.posexplode(suffixes).alias("rank", "suffix")).select("path", "position", "priority", "rank", F.concat("base", "suffix").alias("target"))
    paths = nodes.select(F.col("path").alias("target")).distinct()
    hits = tried.join(paths, "target")
    for language, extension in STAND_INS.items():
        first = paths.where(F.endswith("target", F.lit(extension))).groupBy(parent_column("target").alias("folder")).agg(F.min("target").alias("target")).where("folder <> ''")
        some = base.where(F.col("language") == language).select("path", "position", "priority", F.lit(99).alias("rank"), F.col("base").alias("folder"))
        hits = hits.unionByName(some.join(first, "folder").select(*hits.columns))
    best = hits.groupBy("path", "position").agg(F.min(F.struct("priority", "rank", "target")).alias("best")).select("path", "position", F.col("best.target").alias("target"))
    return imports.join(best, ["path", "position"])


def silo_of(paths: DataFrame, silos: dict[str, list[str]]) -> DataFrame:
    """(path, silo): the first silo by name with a glob that matches; paths of no silo are left out."""
    name = F.lit(None).cast("string")
    for silo in sorted(silos, reverse=True):
        name = F.when(F.col("path").rlike("|".join(glob_regex(g) for g in silos[silo])) if silos[silo] else F.lit(False), F.lit(silo)).otherwise(name)
    return paths.select("path").distinct().withColumn("silo", name).where("silo IS NOT NULL")


def edges(resolved: DataFrame, silos: DataFrame) -> DataFrame:
    """``resolved`` with the silos it leads from and to."""
    to = silos.select(F.col("path").alias("target"), F.col("silo").alias("to_silo"))
    return resolved.join(silos.withColumnRenamed("silo", "from_silo"), "path").join(to, "target")


def violations(resolved: DataFrame, silos: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings, with ``from_silo`` and ``to_silo``, for every import that a rule denies."""
    spark = resolved.sparkSession
    table = [(r.id, r.severity, r.message, r.source, d) for r in rules if r.kind == "boundary" for d in dict.fromkeys(r.deny)]
    denied = spark.createDataFrame(table, "rule_id string, severity string, message string, from_silo string, to_silo string")
    found = edges(resolved, silos).join(F.broadcast(denied), ["from_silo", "to_silo"])
    for r in rules:
        if r.kind == "boundary" and (r.include or r.exclude):
            found = found.where((F.col("rule_id") != r.id) | applies(r))
    same = Window.partitionBy("path", "rule_id", "raw").orderBy("position")
    return (
        found.withColumn("matched", F.col("raw")).withColumn("occurrence", F.row_number().over(same) - 1)
        .withColumn("fingerprint", X.fingerprint("rule_id", "path", "raw", "occurrence")).select(*FINDING_COLUMNS, "from_silo", "to_silo")
    )
