"""Languages of files, and their code lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "rb": "ruby",
}
SLASHES = tuple("c cpp csharp go java javascript rust typescript".split())
HASHES = ("python", "ruby")
LANGUAGES = tuple(dict.fromkeys(EXTENSIONS.values()))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def detect(path: Column | str, content: Column | str) -> Column:
    """By extension; by a ``#!`` line only where the name has none. A leading dot makes no extension."""
    name = F.substring_index(_c(path), "/", -1)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    plain = ~name.rlike(r"^.+\.")
    by_extension = F.lit(None).cast("string")
    for e, language in EXTENSIONS.items():
        by_extension = F.when(extension == e, F.lit(language)).otherwise(by_extension)
    first = F.substring_index(_c(content), "\n", 1)
    by_shebang = F.when(
        F.startswith(first, F.lit("#!")),
        F.when(F.contains(first, F.lit("python")), "python").when(F.contains(first, F.lit("node")), "javascript")
        .when(F.contains(first, F.lit("ruby")), "ruby").when(F.contains(first, F.lit("sh")), "shell"),
    )
    return F.when(plain, by_shebang).otherwise(by_extension)


def comment_prefix(language: Column | str) -> Column:
    """What starts a comment line; null for unknown languages."""
    return F.when(_c(language).isin(*SLASHES), "//").when(_c(language).isin(*HASHES, "shell"), "#")


def code_lines(content: Column | str, language: Column | str) -> Column:
    """Lines with code outside comments; null for languages whose comments aren't known.

    Slash languages: a fold over the lines carries whether a block comment is open; within a line, complete block
    comments are cut, and whatever opens first of ``//`` and ``/*`` ends the code. Strings aren't told apart.
    """
    lines = F.split(_c(content), "\n", -1)
    # whatever stands between comments: closed blocks go, an open block or // takes the rest
    token = r"(?s:/\*.*?\*/|//.*|/\*.*\z)"
    def slash(acc: Column, line: Column) -> Column:
        closes = F.instr(line, "*/")
        still = acc["open"] & (closes == 0)
        rest = F.when(still, F.lit("")).when(acc["open"], F.substr(line, closes + 2)).otherwise(line)
        code = F.regexp_replace(rest, token, " ").rlike(r"(?U)\S")
        last = F.coalesce(F.try_element_at(F.regexp_extract_all(rest, F.lit(f"({token})"), F.lit(1)), F.lit(-1)), F.lit(""))
        opens = F.startswith(last, F.lit("/*")) & ~((F.length(last) >= 4) & F.endswith(last, F.lit("*/")))
        return F.struct((acc["n"] + F.when(code, 1).otherwise(0)).cast("long").alias("n"), (still | opens).alias("open"))

    def block(acc: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"(?U)^\s+", "")
        ends, begins = F.startswith(bare, F.lit("=end")), F.startswith(bare, F.lit("=begin"))
        code = ~acc["open"] & ~begins & (bare != "") & ~F.startswith(bare, F.lit("#"))
        return F.struct((acc["n"] + F.when(code, 1).otherwise(0)).cast("long").alias("n"), F.when(acc["open"], ~ends).otherwise(begins).alias("open"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("open"))
    hashes = F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\S") & ~x.rlike(r"(?U)^\s*#"))).cast("long")
    return (
        F.when(_c(language).isin(*SLASHES), F.aggregate(lines, zero, slash, lambda a: a["n"]))
        .when(_c(language) == "python", hashes)
        .when(_c(language) == "ruby", F.aggregate(lines, zero, block, lambda a: a["n"]))
    )
