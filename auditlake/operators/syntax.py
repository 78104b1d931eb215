"""Structural rules: S-expression queries over syntax trees.

Trees come from Python's own parser for Python and from :mod:`.grammars` for JavaScript, TypeScript, Go, Java and Rust, under the
node and field names that such queries use. A pattern is ``(type field: (pattern) (pattern) "text" ...)``; ``(_)`` matches
any named node, ``_`` any, ``[a b]`` one of several, ``((a) (b))`` siblings; ``?``, ``*`` and ``+`` follow what may be absent
or come more than once (of which the first is captured), ``.`` stands between neighbours, ``!field`` for a field that isn't
there, ``@name`` captures, and ``(#eq? @a "x")``, ``#not-eq?``, ``#match?``, ``#not-match?``, ``#any-of?`` and
``#not-any-of?`` test captured text. Queries for other languages are checked when they are loaded and find nothing, as no
parser for them is at hand.
"""

from __future__ import annotations

import ast
import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rulesets.loader import Rule
from . import grammars
from .grammars import Node
from .matching import _in_envelope, by_file, fingerprint, position, with_language

_TOKEN = re.compile(r'\s+|;[^\n]*|(\()|(\))|(\[)|(\])|"((?:\\.|[^"\\])*)"|(@[\w.-]+)|(#[\w-]+\?)|([\w.]+:)|(_(?![\w])|[A-Za-z_][\w.]*)|(![A-Za-z_]\w*)|([?*+])|(\.)|(#set!)|(.)', re.S)
_TESTS = ("#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?", "#not-any-of?")
PARSED = frozenset(("python", *grammars.READERS))


class QueryError(ValueError):
    pass


@dataclass
class Pattern:
    type: str  # "_" for any, "(_)" for any named one, "|" for alternatives, '"' for literal text
    children: list[tuple[str | None, Pattern]] = field(default_factory=list)
    captures: list[str] = field(default_factory=list)
    literal: str = ""
    times: str = ""  # "?", "*" or "+"
    after: bool = False  # right behind its neighbour, or first
    last: bool = False  # its last child is the node's last
    without: list[str] = field(default_factory=list)  # fields


@dataclass
class Query:
    patterns: list[tuple[Pattern, list[tuple[str, list[str]]]]]


def parse_query(source: str) -> Query:
    if not isinstance(source, str):
        raise QueryError("a query must be a string")
    tokens = []
    for m in _TOKEN.finditer(source):
        if m.lastindex == 14:
            raise QueryError(f"{m[0]!r} isn't understood")
        if m.lastindex:
            tokens.append((m.lastindex, m[m.lastindex]))
    at = 0

    def peek() -> tuple[int, str] | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> tuple[int, str]:
        nonlocal at
        if at >= len(tokens):
            raise QueryError("the query ends too early")
        at += 1
        return tokens[at - 1]

    def captures(p: Pattern) -> Pattern:
        if (t := peek()) and t[0] == 11:
            p.times = take()[1]
        while (t := peek()) and t[0] == 6:
            p.captures.append(take()[1][1:])
        return p

    def tested() -> bool:
        """Whether a test comes next."""
        return peek() is not None and peek()[0] == 1 and at + 1 < len(tokens) and tokens[at + 1][0] in (7, 13)

    def pattern(tests: list, depth: int = 0) -> Pattern:
        kind, text = take()
        if kind == 5:
            return captures(Pattern('"', literal=re.sub(r"\\(.)", r"\1", text)))
        if kind == 9 and text == "_":
            return captures(Pattern("_"))
        if kind == 3:
            p = Pattern("|")
            while peek() and peek()[0] != 4:
                p.children.append((None, pattern(tests, depth + 1)))
            take()
            if not p.children:
                raise QueryError("alternatives are empty")
            return captures(p)
        if kind != 1:
            raise QueryError(f"{text!r} stands where a pattern is needed")
        grouped = peek() is not None and peek()[0] in (1, 3, 5)
        if grouped:
            p = Pattern("_")
        else:
            kind, text = take()
            if kind != 9:
                raise QueryError(f"{text!r} is no node type")
            p = Pattern("(_)" if text == "_" else text)
        after = False
        while True:
            t = peek()
            if t is None:
                raise QueryError("a parenthesis isn't closed")
            if t[0] == 2:
                take()
                p.last = after
                if grouped and len(p.children) == 1 and not p.last:  # one pattern with its tests
                    p = p.children[0][1]
                elif grouped and depth:
                    raise QueryError("siblings in a group are understood at the top only")
                return captures(p)
            if tested():
                test(tests)
            elif t[0] == 12:
                take()
                after = True
            elif t[0] == 10:
                p.without.append(take()[1][1:])
            else:
                name = take()[1][:-1] if t[0] == 8 else None
                child = pattern(tests, depth + 1)
                child.after, after = after, False
                p.children.append((name, child))

    def test(tests: list) -> None:
        take()
        name = take()[1]
        if name not in (*_TESTS, "#set!"):
            raise QueryError(f"{name} isn't known")
        args = []
        while peek() and peek()[0] != 2:
            kind, text = take()
            if kind not in (5, 6) and name != "#set!":
                raise QueryError(f"{text!r} is no argument of {name}")
            args.append(text)
        take()
        if name == "#set!":  # a note to editors
            return
        if not args or not args[0].startswith("@"):
            raise QueryError(f"{name} needs a capture")
        if "match" in name:
            try:
                re.compile(args[1])
            except (re.error, IndexError) as e:
                raise QueryError(f"{name}: bad pattern: {e}") from None
        tests.append((name, args))

    out = []
    while peek():
        tests: list = []
        p = pattern(tests)
        while tested():
            test(tests)
        out.append((p, tests))
    if not out:
        raise QueryError("the query is empty")
    return Query(out)


_OPERATIONS = {
    ast.BoolOp: "boolean_operator", ast.BinOp: "binary_operator", ast.UnaryOp: "unary_operator", ast.Lambda: "lambda", ast.IfExp: "conditional_expression", ast.Dict: "dictionary",
    ast.Set: "set", ast.List: "list", ast.Tuple: "tuple", ast.ListComp: "list_comprehension", ast.SetComp: "set_comprehension", ast.DictComp: "dictionary_comprehension",
    ast.GeneratorExp: "generator_expression", ast.Await: "await", ast.Yield: "yield", ast.Compare: "comparison_operator", ast.JoinedStr: "string", ast.Starred: "list_splat",
    ast.Return: "return_statement", ast.Delete: "delete_statement", ast.For: "for_statement", ast.While: "while_statement", ast.If: "if_statement", ast.With: "with_statement",
    ast.Raise: "raise_statement", ast.Try: "try_statement", ast.Assert: "assert_statement", ast.Global: "global_statement", ast.Nonlocal: "nonlocal_statement",
    ast.Pass: "pass_statement", ast.Break: "break_statement", ast.Continue: "continue_statement", ast.ExceptHandler: "except_clause", ast.Match: "match_statement", ast.NamedExpr: "named_expression",
}


class _Builder:
    def __init__(self, source: str):
        self.source = source
        self.lines = [0]
        raw = source.encode("utf-8", "surrogatepass")
        self.raw, at = raw, -1
        while (at := raw.find(b"\n", at + 1)) >= 0:
            self.lines.append(at + 1)
        self.ascii = source.isascii()

    def place(self, line: int, column: int) -> int:
        at = self.lines[line - 1] + column
        return at if self.ascii else len(self.raw[:at].decode("utf-8", "replace"))

    def span(self, n: ast.AST) -> tuple[int, int]:
        return self.place(n.lineno, n.col_offset), self.place(n.end_lineno, n.end_col_offset)

    def name_after(self, start: int, name: str, word: str) -> Node:
        m = re.compile(r"(?:async\s+)?" + word + r"\s+(" + re.escape(name) + ")").search(self.source, start)
        a, b = m.span(1) if m else (start, start)
        return Node("identifier", a, b)

    def dotted(self, name: str, start: int, end: int) -> Node:
        m = re.compile(re.escape(name).replace(r"\.", r"\s*\.\s*")).search(self.source, start, end)
        a, b = m.span() if m else (start, start)
        return Node("dotted_name", a, b)

    def many(self, nodes: list) -> list[tuple[str | None, Node]]:
        return [(None, self.build(n)) for n in nodes if n is not None]

    def block(self, nodes: list) -> Node:
        kids = self.many(nodes)
        return Node("block", kids[0][1].start, kids[-1][1].end, kids)

    def build(self, n: ast.AST) -> Node:
        a, b = self.span(n) if hasattr(n, "lineno") else (0, len(self.source))
        if isinstance(n, ast.Module):
            return Node("module", a, b, self.many(n.body))
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(n, ast.ClassDef) else "function"
            name = self.name_after(a, n.name, "class" if kind == "class" else "def")
            kids = [("name", name)]
            if kind == "function":
                args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
                kids.append(("parameters", Node("parameters", name.end, name.end, [(None, Node("identifier", *self.span(x))) for x in args])))
            elif n.bases:
                kids.append(("superclasses", Node("argument_list", *self.span(n.bases[0]), self.many(n.bases))))
            kids.append(("body", self.block(n.body)))
            node = Node(f"{kind}_definition", a, b, kids)
            if n.decorator_list:
                kids_ = [(None, Node("decorator", self.span(d)[0] - 1, self.span(d)[1], [(None, self.build(d))])) for d in n.decorator_list]
                return Node("decorated_definition", kids_[0][1].start, b, [*kids_, ("definition", node)])
            return node
        if isinstance(n, ast.Import):
            kids = []
            for x in n.names:
                d = self.dotted(x.name, *self.span(x))
                kids.append(("name", Node("aliased_import", *self.span(x), [("name", d)]) if x.asname else d))
            return Node("import_statement", a, b, kids)
        if isinstance(n, ast.ImportFrom):
            m = re.compile(r"from\s*([.\s]*(?:[\w.]+)?)\s*import").search(self.source, a)
            p, q = m.span(1) if m else (a, a)
            kind = "relative_import" if n.level else "future_import" if n.module == "__future__" else "dotted_name"
            kids = [("module_name", Node(kind, p, q - (len(m[1]) - len(m[1].rstrip())) if m else q))]
            return Node("import_from_statement", a, b, kids + [("name", Node("dotted_name", *self.span(x))) for x in n.names if x.name != "*"])
        if isinstance(n, ast.Expr):
            return Node("expression_statement", a, b, self.many([n.value]))
        if isinstance(n, ast.Call):
            args = [self.build(x) for x in n.args]
            for k in n.keywords:
                p, q = self.span(k)
                kids = ([("name", Node("identifier", p, p + len(k.arg)))] if k.arg else []) + [("value", self.build(k.value))]
                args.append(Node("keyword_argument" if k.arg else "dictionary_splat", p, q, kids))
            args.sort(key=lambda x: x.start)
            f = self.build(n.func)
            return Node("call", a, b, [("function", f), ("arguments", Node("argument_list", f.end, b, [(None, x) for x in args]))])
        if isinstance(n, ast.Name):
            return Node("identifier", a, b)
        if isinstance(n, ast.Attribute):
            return Node("attribute", a, b, [("object", self.build(n.value)), ("attribute", Node("identifier", b - len(n.attr), b))])
        if isinstance(n, ast.Subscript):
            return Node("subscript", a, b, [("value", self.build(n.value)), ("subscript", self.build(n.slice))])
        if isinstance(n, ast.Constant):
            v = n.value
            kind = "true" if v is True else "false" if v is False else "none" if v is None else "string" if isinstance(v, (str, bytes)) else "float" if isinstance(v, (float, complex)) else "ellipsis" if v is ... else "integer"
            return Node(kind, a, b)
        if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            left = n.targets[0] if isinstance(n, ast.Assign) else n.target
            kids = [("left", self.build(left))] + ([("right", self.build(n.value))] if n.value else [])
            return Node("augmented_assignment" if isinstance(n, ast.AugAssign) else "assignment", a, b, kids)
        kind = _OPERATIONS.get(type(n), type(n).__name__.lower())
        kids = []
        for name, value in ast.iter_fields(n):
            if isinstance(value, list) and value and isinstance(value[0], ast.stmt):
                kids.append(("consequence" if name == "body" and kind == "if_statement" else "alternative" if name == "orelse" else name, self.block(value)))
            elif isinstance(value, list):
                kids += [(None, self.build(v)) for v in value if isinstance(v, ast.AST) and hasattr(v, "lineno")]
            elif isinstance(value, ast.AST) and hasattr(value, "lineno"):
                kids.append(({"test": "condition"}.get(name, name), self.build(value)))
        return Node(kind, a, b, kids)


FAULTS = 64  # lines that may be left out of a Python file


def python_tree(source: str) -> Node | None:
    """The tree of a Python file without the lines that its parser stops at; None beyond ``FAULTS`` of these."""
    text = source
    for _ in range(FAULTS + 1):
        try:
            return _Builder(source).build(ast.parse(text))
        except SyntaxError as e:
            lines = text.split("\n")
            k = min(e.lineno or len(lines), len(lines)) - 1
            while k > 0 and not lines[k].strip():
                k -= 1
            lines[k] = ""
            text = "\n".join(lines)
        except (ValueError, RecursionError, MemoryError):
            return None
    return None


def _fit(p: Pattern, n: Node, source: str) -> Iterator[dict[str, Node]]:
    """Captures of every way in which a pattern fits a node."""
    if p.type == "|":
        for _, alternative in p.children:
            for got in _fit(alternative, n, source):
                yield {**{c: n for c in p.captures}, **got}
        return
    if p.type == '"':
        if source[n.start : n.end] == p.literal:
            yield {c: n for c in p.captures}
        return
    if p.type not in ("_", n.type) and not (p.type == "(_)" and n.named):
        return
    if p.without and any(label in p.without for label, _ in n.children):
        return

    def rest(k: int, start: int, behind: int) -> Iterator[dict[str, Node]]:
        """From child ``start`` on; ``behind`` is the one after what was matched last."""
        if k == len(p.children):
            if not p.last or not any(c.named for _, c in n.children[behind:]):
                yield {}
            return
        name, child = p.children[k]
        found = False
        for i in range(behind if child.after else start if name is None else 0, len(n.children)):
            label, node = n.children[i]
            if name is None or label == name:
                for got in _fit(child, node, source):
                    for more in rest(k + 1, i + 1 if name is None else start, i + 1):
                        found = True
                        yield {**got, **more}
                    if found and child.times:
                        break
            if (found and child.times) or (child.after and node.named):
                break
        if not found and child.times in ("?", "*"):
            yield from rest(k + 1, start, behind)

    for got in rest(0, 0, 0):
        yield {**{c: n for c in p.captures}, **got}


def _passes(tests: list, got: dict[str, Node], source: str) -> bool:
    for name, args in tests:
        n = got.get(args[0][1:])
        if n is None:
            continue
        text = source[n.start : n.end]
        others = [source[got[a[1:]].start : got[a[1:]].end] if a.startswith("@") and a[1:] in got else a for a in args[1:]]
        ok = {"#eq?": lambda: text == others[0], "#not-eq?": lambda: text != others[0], "#match?": lambda: bool(re.search(others[0], text)), "#not-match?": lambda: not re.search(others[0], text), "#any-of?": lambda: text in others, "#not-any-of?": lambda: text not in others}[name]()
        if not ok:
            return False
    return True


def search(query: Query, tree: Node, source: str) -> Iterator[Node]:
    """The node that each match reports: ``@report``, else its first capture that isn't a helper (``@_name``), else the whole."""
    stack = [tree]
    while stack:
        n = stack.pop()
        stack.extend(c for _, c in reversed(n.children))
        for p, tests in query.patterns:
            for got in _fit(p, n, source):
                if _passes(tests, got, source):
                    shown = [c for c in got if not c.startswith("_")]
                    yield got["report"] if "report" in got else got[shown[0]] if shown else n


@functools.lru_cache(maxsize=256)
def _query(source: str) -> Query:
    return parse_query(source)


REMEMBERED = 4096  # characters of a file at most, of which copies aren't parsed again; a worker keeps 1,024 of these


@functools.lru_cache(maxsize=1024)
def _found(mine: tuple[tuple[int, str], ...], language: str, content: str) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end) of what the queries of some rules report, in order."""
    tree = python_tree(content) if language == "python" else grammars.tree(language, content)
    return [] if tree is None else sorted({(n.start, k, n.end) for k, q in mine for n in search(_query(q), tree, content)})


def file_findings(rules: list[Rule], path: str, language: str | None, content: str) -> list[tuple]:
    mine = [(k, dict(r.queries)[language]) for k, r in enumerate(rules) if language in dict(r.queries) and _in_envelope(r, path, language)]
    if not mine or language not in PARSED:
        return []
    look = _found if len(content) <= REMEMBERED else _found.__wrapped__
    out, seen = [], Counter()
    for a, k, b in look(tuple(mine), language, content):
        rule, matched = rules[k], content[a:b]
        key = (k, " ".join(matched.split()))
        out.append((rule.id, rule.severity, rule.message, path, *position(content, a), matched, fingerprint(rule.id, path, matched, seen[key])))
        seen[key] += 1
    return out


def findings(files: DataFrame, rules: list[Rule], max_bytes: int = 2 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Findings of structural rules, in files of their languages and of at most ``max_bytes`` that hold the texts a match needs."""
    rules = [r for r in rules if r.kind == "ast"]
    languages = sorted(set(itertools.chain.from_iterable(dict(r.queries) for r in rules)))
    some = with_language(files).where(F.col("language").isin(*languages) & (F.octet_length("content") <= max_bytes) & F.col("path").isNotNull())
    wanted = functools.reduce(lambda a, b: a | b, (_can_match(q, F.col("language") == language) for r in rules for language, q in r.queries), F.lit(False))
    return by_file(some.where(wanted), lambda path, language, content: file_findings(rules, path, language, content), carry)


def unparsed(rules: list[Rule]) -> list[str]:
    """What has to be said of rules with queries for languages that have no parser here."""
    out = []
    for r in rules:
        if others := sorted(set(dict(r.queries)) - PARSED):
            out.append(f"rule {r.id}: no parser for {', '.join(others)}, so its queries for these find nothing")
    return out


def literals(source: str) -> list[list[str]]:
    """For each pattern of a query, texts that a file needs for a match: what ``#eq?`` compares with, and literal children."""

    def inside(p: Pattern) -> Iterator[str]:
        if p.times in ("?", "*"):
            return
        if p.type == '"':
            yield p.literal
        elif p.type != "|":
            for _, c in p.children:
                yield from inside(c)

    def bound(p: Pattern) -> Iterator[str]:
        """Captures that every match has."""
        if p.type != "|" and p.times not in ("?", "*"):
            yield from p.captures
            for _, c in p.children:
                yield from bound(c)

    return [[*inside(p), *(args[1] for name, args in tests if name == "#eq?" and not args[1].startswith("@") and args[0][1:] in set(bound(p)))] for p, tests in _query(source).patterns]


def _can_match(source: str, base: Column) -> Column:
    """Whether a file of the right language holds the texts that some pattern needs."""
    alternatives = [functools.reduce(lambda a, b: a & b, (F.contains(F.col("content"), F.lit(t)) for t in some), F.lit(True)) for some in literals(source)]
    return base & functools.reduce(lambda a, b: a | b, alternatives)


def oversized(files: DataFrame, rules: list[Rule], max_bytes: int = 2 << 20) -> DataFrame:
    """(path, reason) of files that a structural or boundary rule would need parsed but for their size."""
    languages = sorted({x for r in rules for x in dict(r.queries)})
    wanted = F.col("language").isNotNull() if any(r.kind == "boundary" for r in rules) else F.col("language").isin(*languages)
    big = with_language(files).where(wanted & (F.octet_length("content") > max_bytes))
    return big.select("path", F.concat(F.lit("larger than the parse limit of "), F.lit(max_bytes).cast("string"), F.lit(" bytes")).alias("reason"))
