"""Path algebra and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def top_dir(path: Column | str) -> Column:
    """First segment of a path with directories, else ``.``."""
    return F.when(F.instr(_c(path), "/") > 1, F.substring_index(_c(path), "/", 1)).otherwise(".")


def parent(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def family(path: Column | str) -> Column:
    return F.when(F.instr(_c(path), "/") > 1, F.substring_index(_c(path), "/", 1)).otherwise("core")


def anchored(prefix: str, path: Column | str) -> Column:
    return F.concat(F.lit(prefix.strip("/") + "/"), _c(path)) if prefix.strip("/") else _c(path)


def normalized(path: Column | str) -> Column:
    return F.translate(_c(path), "\\", "/")


def has_suffix(path: Column | str, tail: Column | str) -> Column:
    """Whether ``path`` ends with the whole segments of ``tail``."""
    return (_c(path) == _c(tail)) | F.endswith(_c(path), F.concat(F.lit("/"), _c(tail)))


def joined(base: Column | str, rel: Column | str) -> Column:
    """``base/rel`` with ``.`` and ``..`` resolved; null where it leaves the root or is empty."""
    segments = F.filter(F.split(F.concat_ws("/", _c(base), _c(rel)), "/"), lambda s: ~s.isin("", "."))
    start = F.array().cast("array<string>")
    stack = F.aggregate(
        segments, start,
        lambda acc, s: F.when(acc.isNull() | ((s == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>"))
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(F.size(stack) > 0, F.array_join(stack, "/"))


def join_path(base: str, rel: str) -> str | None:
    """The same for strings."""
    parts: list[str] = []
    for s in [*base.split("/"), *rel.split("/")]:
        if s == "..":
            if not parts:
                return None
            parts.pop()
        elif s not in ("", "."):
            parts.append(s)
    return "/".join(parts) or None


def ascend(directory: str, count: int) -> str | None:
    parts = [p for p in directory.split("/") if p]
    return "/".join(parts[: len(parts) - count]) if len(parts) >= count else None


class GlobError(ValueError):
    pass


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for whole paths.

    ``*`` and ``?`` also match slashes; ``**`` stands for whole directories at a segment's place; classes, alternatives
    in braces and backslash escapes are known.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == len(glob) or glob[i + 2] == "/"):
            if i + 2 == len(glob):
                out.append(".*")
                i += 2
            else:
                out.append("(?:.*/)?")
                i += 3
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "^") else i + 1)
            if end == i + 1 or end < 0:
                end = glob.find("]", end + 1) if end == i + 1 else end
            if end < 0:
                raise GlobError(f"unclosed class in {glob!r}")
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]&^])", r"\\\1", body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if i + 1 == len(glob):
                raise GlobError(f"nothing to escape in {glob!r}")
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise GlobError(f"unclosed alternatives in {glob!r}")
    return r"^(?s:" + "".join(out) + r")\z"


def matches_any(path: Column | str, globs: list[str]) -> Column:
    """Whether a path matches one of the globs."""
    return _c(path).rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def python_glob(glob: str) -> re.Pattern:
    return re.compile(glob_regex(glob).replace(r"\z", r"\Z"))
