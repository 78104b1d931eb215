"""Imports and declarations of source files.

Python comes from its own parser. For the other languages, comments and strings are blanked first and the statements are
found lexically; this covers their usual forms, not every one that a full grammar knows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import SLASHES
from ..model import DECLARATIONS, IMPORTS
from .matching import position, with_language
from .syntax import python_tree

_STRING = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_SLASH = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|" + _STRING + r"|`(?:\\.|[^`\\])*`", re.S)
_HASH = re.compile(r"^=begin\b.*?^=end\b[^\n]*|#[^\n]*|" + _STRING, re.S | re.M)
_IMPORTS = {
    "rust": [r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use\s+([^;]+);"],
    "javascript": [r"(?m)^[ \t]*(?:import|export)\b[^;\"'`\n]*?(?:\{[^}]*\}[^;\"'`\n]*?)?(?:\bfrom\s*)?(['\"][^'\"\n]*['\"])", r"\brequire\s*\(\s*(['\"][^'\"\n]*['\"])\s*\)"],
    "go": [],
    "java": [r"(?m)^[ \t]*(import\s+[^;]+;)"],
    "c": [r"(?m)^[ \t]*#[ \t]*include[ \t]*(<[^>\n]+>|\"[^\"\n]+\")"],
    "csharp": [r"(?m)^[ \t]*((?:global\s+)?using\s+[^;(]+;)"],
    "ruby": [r"(?m)\brequire(?:_relative)?[ \t]*\(?[ \t]*(['\"][^'\"\n]*['\"])"],
}
_IMPORTS["typescript"], _IMPORTS["cpp"] = _IMPORTS["javascript"], _IMPORTS["c"]
_MODS = r"(?:(?:public|protected|private|internal|static|final|abstract|sealed|partial|async|override|virtual|readonly|export|default|declare|pub(?:\([^)]*\))?|unsafe|extern|const|inline|synchronized|native)\s+)*"
_CALLABLE = r"(?m)(?:^|[{};])[ \t]*(?!(?:return|if|for|while|switch|else|new|throw|catch|using|case|do|try|await|function|class)\b)"
_DECLS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", r"\bfn\s+(\w+)"), ("struct", r"\b(?:struct|union)\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("type", r"\btype\s+(\w+)"), ("const", r"\b(?:const|static)\s+(?:mut\s+)?(?!fn\b|unsafe\b|extern\b|async\b)([A-Za-z_]\w*)\s*:")],
    "javascript": [("function", r"\bfunction\s*\*?\s*(\w+)\s*\("), ("class", r"\bclass\s+(\w+)"), ("method", _CALLABLE + r"(?:(?:static|async|get|set)\s+)*\*?(#?\w+)\s*\([^()]*\)\s*\{"), ("const", r"\bconst\s+([A-Za-z_$][\w$]*)\s*=")],
    "typescript": [("function", r"\bfunction\s*\*?\s*(\w+)\s*[(<]"), ("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("type", r"(?m)^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("method", _CALLABLE + r"(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*\*?(#?\w+)\s*\([^()]*\)\s*(?::[^;{}=]+)?\{"), ("const", r"\bconst\s+(?!enum\b)([A-Za-z_$][\w$]*)\s*[=:]")],
    "go": [("function", r"(?m)^func\s+(\w+)\s*[(\[]"), ("method", r"(?m)^func\s*\([^)]*\)\s*(\w+)"), ("struct", r"(?m)^[ \t]*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+struct\s*\{"), ("interface", r"(?m)^[ \t]*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+interface\s*\{"), ("type", r"(?m)^type\s+(\w+)\s+(?!struct\b|interface\b)"), ("const", r"(?m)^const\s+(\w+)")],
    "java": [("class", r"\b(?:class|record)\s+(\w+)"), ("interface", r"\b@?interface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("method", _CALLABLE + _MODS + r"(?:<[^>]+>\s*)?(?:[\w.<>\[\],? ]+\s+)?(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w., ]+)?\s*[{;]")],
    "c": [("function", _CALLABLE + r"(?:[\w*]+[ \t*]+)+?\**(\w+)\s*\([^;{}()]*\)\s*\{"), ("struct", r"\b(?:struct|union)\s+(\w+)\s*\{"), ("enum", r"\benum\s+(\w+)\s*\{"), ("type", r"\btypedef\b[^;{}]*(?:\{[^{}]*\})?[^;{}]*?\b(\w+)\s*;"), ("const", r"(?m)^[ \t]*#[ \t]*define[ \t]+(\w+)")],
    "csharp": [("class", r"\b(?:class|record)\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("type", r"\bdelegate\s+[\w<>\[\], ]+?\s+(\w+)\s*\("), ("method", _CALLABLE + _MODS + r"(?:[\w.<>\[\],? ]+\s+)?(\w+)\s*\([^()]*\)\s*(?:\{|=>)")],
    "ruby": [("class", r"(?m)^[ \t]*class\s+(?:\w+::)*([A-Z]\w*)"), ("module", r"(?m)^[ \t]*module\s+(?:\w+::)*([A-Z]\w*)"), ("method", r"(?m)^[ \t]*def\s+(?:self\.)?(\w+[?!=]?)"), ("const", r"(?m)^[ \t]*([A-Z]\w*)\s*=(?!=)")],
}
_DECLS["cpp"] = [*_DECLS["c"], ("class", r"\bclass\s+(\w+)\s*(?:final\s*)?[:{]"), ("type", r"\busing\s+(\w+)\s*="), ("method", r"\b\w+::(~?\w+)\s*\([^;{}()]*\)\s*(?:const\s*)?\{")]


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def bare(language: str, source: str, strings: bool) -> str:
    """The source with comments blanked, and the insides of strings too where ``strings`` is set; offsets stay."""
    def one(m: re.Match) -> str:
        comment = m[0][0] not in "\"'`"
        return _blank(m) if comment else (m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if strings else m[0])

    if language in SLASHES:
        return _SLASH.sub(one, source)
    return _HASH.sub(one, source)


def normalize_import(language: str, raw: str) -> str:
    """The import without directive words, semicolon, quotes or brackets, as its language has them."""
    if language in ("java", "csharp"):
        words = raw.strip().rstrip(";").split()
        while words and words[0] in ("import", "static", "using", "global", "unsafe"):
            words.pop(0)
        return " ".join(words)
    if language in ("rust", "python"):
        return raw.strip()
    return raw.strip().strip("\"'`<>").strip()


def imports(language: str, source: str) -> list[tuple[int, str]]:
    """(offset, text) of the imports, in order."""
    found: list[tuple[int, str]] = []
    if language == "python":
        tree = python_tree(source)
        stack = [tree] if tree else []
        while stack:
            n = stack.pop()
            stack.extend(c for _, c in n.children)
            if n.type == "import_statement":
                found += [(d.start, source[d.start : d.end]) for _, c in n.children for d in ([c.children[0][1]] if c.type == "aliased_import" else [c])]
            elif n.type == "import_from_statement" and n.children[0][1].type != "future_import":
                d = n.children[0][1]
                found.append((d.start, re.sub(r"\s+", "", source[d.start : d.end])))
    elif language == "go":
        code = bare(language, source, False)
        for m in re.finditer(r"(?m)^[ \t]*import\s*(?:\((.*?)\)|([^\n]+))", code, re.S):
            for s in re.finditer(r"\"[^\"\n]*\"|`[^`\n]*`", code[m.start() : m.end()]):
                found.append((m.start() + s.start(), normalize_import(language, s[0])))
    else:
        code = bare(language, source, False)
        for p in _IMPORTS.get(language, []):
            found += [(m.start(1), normalize_import(language, m[1])) for m in re.finditer(p, code)]
    return sorted({x for x in found if x[1]})


def declarations(language: str, source: str) -> list[tuple[int, str, str]]:
    """(offset, name, kind) of the declarations, in order, each place once."""
    if language == "python":
        tree, found = python_tree(source), []
        stack = [tree] if tree else []
        while stack:
            n = stack.pop()
            stack.extend(c for _, c in n.children)
            if n.type in ("function_definition", "class_definition"):
                d = n.children[0][1]
                found.append((d.start, source[d.start : d.end], n.type.split("_")[0]))
        return sorted(found)
    code, seen = bare(language, source, True), {}
    for kind, p in _DECLS.get(language, []):
        for m in re.finditer(p, code):
            seen.setdefault(m.start(1), (m[1], kind))
    return sorted((a, n, k) for a, (n, k) in seen.items())


def _run(files: DataFrame, schema, rows_of) -> DataFrame:
    arrow = pa.schema([(f.name, pa.int64() if f.dataType.simpleString() == "bigint" else pa.string()) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, language, c in zip(*(x.to_pylist() for x in b.columns)) for r in rows_of(p, language, c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    some = with_language(files).where(F.col("language").isNotNull() & F.col("path").isNotNull() & F.col("content").isNotNull())
    return some.select("path", "language", "content").mapInArrow(run, schema)


def import_table(files: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    """Imports of all files; larger ones than ``max_bytes`` have none."""
    def rows(path: str, language: str, content: str) -> Iterator[tuple]:
        for k, (at, raw) in enumerate(imports(language, content)):
            yield path, language, k, raw, *position(content, at)

    # every import of any of the languages is announced by one of these words
    return _run(files.where((F.octet_length("content") <= max_bytes) & F.col("content").rlike("import|require|include|use|using|from|export|mod")), IMPORTS, rows)


def declaration_table(files: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    def rows(path: str, language: str, content: str) -> Iterator[tuple]:
        for at, name, kind in declarations(language, content):
            yield path, name, kind, position(content, at)[0]

    return _run(files.where(F.octet_length("content") <= max_bytes), DECLARATIONS, rows)


def parses(source: str) -> bool:
    try:
        ast.parse(source)
    except (SyntaxError, ValueError):
        return False
    return True
