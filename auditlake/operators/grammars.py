"""Syntax trees of JavaScript, TypeScript, Go, Java and Rust, under the node and field names that tree queries use for them.

A lexer by regular expression, precedence climbing for expressions, one method per kind of statement. What can't be read
becomes an ``ERROR`` node that ends with its statement, and reading goes on behind it, so every source has a tree. Types,
and Rust's patterns, are read as names and balanced brackets, and macros as their tokens. Not read: JSX.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Node:
    type: str
    start: int
    end: int
    children: list[tuple[str | None, Node]] = field(default_factory=list)
    named: bool = True  # operators and modifiers aren't


class _Wrong(Exception):
    pass


_WORD = r"(?P<id>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)"
_NUMBER = r"(?P<num>0[xXbBoO][\da-fA-F_]+[nlL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eEpP][+-]?\d+)?[nlLfFdDi]?)"
_STRING = r"(?P<str>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
_COMMENT = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_SPACE = r"(?P<space>[^\S\n]+)|(?P<line>\n)"
_SIGNS = ">>>= ... >> === !== **= <<= >>= >>> &&= ||= ??= &^= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << ** :: -> := <- &^".split()
_OP = "(?P<op>" + "|".join(map(re.escape, sorted(_SIGNS, key=len, reverse=True))) + r"|[^\w\s])"
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_RAW = re.compile(r'"""(?:\\.|[^\\])*?(?:"""|\Z)', re.S)
_LEX = re.compile("|".join((_SPACE, _COMMENT, _NUMBER, _WORD, _STRING, _OP)), re.S)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= &^=".split())
_LEVELS = {
    "??": 3, "||": 3, "&&": 4, "|": 5, "^": 6, "&": 7, "==": 8, "!=": 8, "===": 8, "!==": 8, "<": 9, ">": 9, "<=": 9, ">=": 9, "in": 9, "instanceof": 9,
    "<<": 10, ">>": 10, ">>>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 13,
}
_GO_LEVELS = {"||": 1, "&&": 2, **dict.fromkeys("== != < <= > >=".split(), 3), **dict.fromkeys("+ - | ^".split(), 4), **dict.fromkeys("* / % << >> & &^".split(), 5)}


class Reader:
    """Tokens (kind, text, start, end, whether a line ends before) of a source, and what all languages share."""

    comment = ("comment", "comment")  # of a line, of a block
    levels = _LEVELS
    unary = frozenset("! ~ + - typeof void delete".split())
    block_type, root = "statement_block", "program"
    keywords: frozenset[str] = frozenset()

    def __init__(self, source: str, first: int = 0, end: int | None = None):
        self.source, self.at = source, 0
        self.failed: set[tuple[str, int]] = set()  # what was tried where in vain, so that it isn't again within a second reading
        self.tokens: list[tuple[str, str, int, int, bool]] = []
        self.notes: list[Node] = []
        self.lex(first, len(source) if end is None else end)
        self.match: dict[int, int] = {}
        open_: list[int] = []
        for i, (kind, text, *_rest) in enumerate(self.tokens):
            if kind == "op" and text in _OPEN:
                open_.append(i)
            elif kind == "op" and text in _CLOSE:
                while open_ and _OPEN[self.tokens[open_[-1]][1]] != text:
                    open_.pop()
                if open_:
                    self.match[open_.pop()] = i

    # --- tokens

    def lex(self, at: int, end: int) -> None:
        line = False
        while at < end:
            special = self.special(at)
            if special is not None:
                kind, stop = special
            else:
                m = _LEX.match(self.source, at, end)
                if m is None:
                    at += 1
                    continue
                kind, stop = m.lastgroup, m.end()
            if kind == "line":
                line = True
                self.ended()
            elif kind == "comment":
                text = self.source[at:stop]
                self.notes.append(Node(self.comment[text.startswith("/*")], at, stop))
                if "\n" in text:
                    line = True
                    self.ended()
            elif kind != "space":
                self.tokens.append((kind, self.source[at:stop], at, stop, line))
                line = False
            at = stop
        self.ended()

    def special(self, at: int) -> tuple[str, int] | None:
        return None

    def ended(self) -> None:
        """Called at a line's end."""

    @property
    def text(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def ahead(self, n: int = 1) -> str:
        return self.tokens[self.at + n][1] if 0 <= self.at + n < len(self.tokens) else ""

    def ahead_kind(self, n: int = 1) -> str:
        return self.tokens[self.at + n][0] if 0 <= self.at + n < len(self.tokens) else ""

    @property
    def start(self) -> int:
        return self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.source)

    @property
    def behind(self) -> int:
        """The end of the last token that was taken."""
        return self.tokens[self.at - 1][3] if self.at else 0

    def is_(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "id") and self.text in texts

    def take(self, text: str | None = None) -> tuple[str, str, int, int, bool]:
        if self.at >= len(self.tokens) or (text is not None and not self.is_(text)):
            raise _Wrong
        self.at += 1
        return self.tokens[self.at - 1]

    def skip(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.at += 1
            return True
        return False

    def leaf(self, type_: str) -> Node:
        _, _, a, b, _ = self.take()
        return Node(type_, a, b)

    any_name = False  # whether keywords are names, too

    def name(self, type_: str = "identifier") -> Node:
        if self.kind != "id" or (not self.any_name and self.text in self.keywords):
            raise _Wrong
        return self.leaf(type_)

    def closing(self) -> int:
        """The place of the bracket that closes the one at hand."""
        if self.at not in self.match:
            raise _Wrong
        return self.match[self.at]

    def node(self, type_: str, start: int, *children: tuple[str | None, Node | None]) -> Node:
        return Node(type_, start, max(self.behind, start), [(f, c) for f, c in children if c is not None])

    def balanced(self, type_: str, stops: Callable[[], bool]) -> Node:
        """Tokens up to a stop outside of brackets, as one node with its names below."""
        a, kids = self.start, []
        depth = 0
        while self.at < len(self.tokens) and (depth or not stops()):
            if self.is_("<"):
                depth += 1
            elif depth and self.is_(">", ">>", ">>>"):
                depth = max(0, depth - len(self.text))
            elif self.kind == "op" and self.text in _OPEN:
                self.at = self.closing()
            elif self.kind == "op" and self.text in (*_CLOSE, ";"):
                break
            if self.kind == "id":
                kids.append((None, Node("type_identifier", self.start, self.tokens[self.at][3])))
            self.at += 1
        if self.behind <= a and not kids:
            raise _Wrong
        return self.node(type_, a, *kids)

    def error(self, a: int, before: int) -> Node:
        """What couldn't be read, up to the end of its line or statement; brackets are left as wholes."""
        self.at = max(self.at, before)
        while self.at < len(self.tokens):
            if self.kind == "op" and self.text in _OPEN and self.at in self.match:
                self.at = self.match[self.at]
            elif self.is_("}", ";") or (self.at > before and self.tokens[self.at][4]):
                if self.is_(";") or self.at == before:
                    self.at += 1
                break
            self.at += 1
        return Node("ERROR", a, max(self.behind, a))

    def statements(self, stops: Callable[[], bool], one: Callable[[], Node | None] | None = None) -> list[tuple[None, Node]]:
        out = []
        while self.at < len(self.tokens) and not stops():
            a, before = self.start, self.at
            try:
                n = (one or self.statement)()
            except _Wrong:
                n = self.error(a, before)
            if self.at == before:
                self.at += 1
            if n is not None:
                out.append((None, n))
        return out

    def block(self, type_: str | None = None, one: Callable[[], Node | None] | None = None) -> Node:
        a, end = self.start, self.closing() if self.is_("{") else -1
        self.take("{")
        kids = self.statements(lambda: self.at >= end, one)
        self.at = end + 1
        return self.node(type_ or self.block_type, a, *kids)

    def listed(self, type_: str, one: Callable[[], tuple[str | None, Node] | Node | None]) -> Node:
        """What a bracket holds, between commas."""
        a, end = self.start, self.closing()
        self.at += 1
        kids = []
        while self.at < end:
            if self.skip(","):
                continue
            n = one()
            if n is not None:
                kids.append(n if isinstance(n, tuple) else (None, n))
            if self.at < end and not self.is_(",", ";"):
                raise _Wrong
            self.skip(";")
        self.at = end + 1
        return self.node(type_, a, *kids)

    def tree(self) -> Node:
        kids = self.statements(lambda: False)
        kids += [(None, n) for n in self.notes]
        kids.sort(key=lambda k: k[1].start)
        return Node(self.root, 0, len(self.source), kids)

    # --- expressions

    def statement(self) -> Node | None:
        raise NotImplementedError

    def primary(self) -> Node:
        raise NotImplementedError

    def postfix(self, n: Node) -> Node:
        raise NotImplementedError

    def sign(self) -> Node:
        """An operator: a node of no name that its text matches."""
        _, text, a, b, _ = self.take()
        return Node(text, a, b, named=False)

    def expression(self, level: int = 0) -> Node:
        a = self.start
        left = self.prefix()
        while self.at < len(self.tokens) and self.kind in ("op", "id"):
            own = self.levels.get(self.text)
            if own is None or own <= level or not self.goes_on():
                break
            op = self.sign()
            right = self.expression(own - 1 if op.type == "**" else own)
            left = self.binary(a, left, op, right)
        return left

    def goes_on(self) -> bool:
        return True

    def binary(self, a: int, left: Node, op: Node, right: Node) -> Node:
        return self.node("binary_expression", a, ("left", left), ("operator", op), ("right", right))

    def prefix(self) -> Node:
        a = self.start
        if self.kind in ("op", "id") and self.text in self.unary:
            op = self.sign()
            return self.node("unary_expression", a, ("operator", op), (self.operand, self.prefix()))
        return self.postfix(self.primary())

    operand = "argument"

    def inner(self) -> Node:
        """(expression)"""
        a = self.start
        self.take("(")
        n = self.whole()
        self.take(")")
        return self.node("parenthesized_expression", a, (None, n))

    def whole(self) -> Node:
        return self.expression()


# --- JavaScript and TypeScript

class JavaScript(Reader):
    keywords = frozenset(
        "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return switch throw try typeof var void while with".split()
    )
    typed, any_name = False, True

    def special(self, at: int) -> tuple[str, int] | None:
        c = self.source[at]
        if c == "`":
            return "template", self.quoted(at)
        if c == "/" and self.source[at + 1 : at + 2] not in ("/", "*"):
            last = self.tokens[-1] if self.tokens else None
            if last is None or (last[0] == "op" and last[1] not in (")", "]", "}", "++", "--")) or (last[0] == "id" and last[1] in self.keywords):
                m = _REGEX.match(self.source, at)
                if m:
                    return "regex", m.end()
        return None

    def quoted(self, at: int) -> int:
        """The end of the template string at ``at``, whose substitutions may hold others."""
        depth, at = [-1], at + 1  # braces open in the substitution at hand; -1 in text
        while at < len(self.source):
            c = self.source[at]
            if depth[-1] < 0:
                if c == "\\":
                    at += 1
                elif c == "`":
                    depth.pop()
                    if not depth:
                        return at + 1
                elif self.source.startswith("${", at):
                    depth.append(0)
                    at += 1
            elif c == "`":
                depth.append(-1)
            elif c == "{":
                depth[-1] += 1
            elif c == "}":
                if depth[-1]:
                    depth[-1] -= 1
                else:
                    depth.pop()
            at += 1
        return at

    def goes_on(self) -> bool:
        return not (self.text == "in" and self.no_in)

    no_in = False

    def whole(self) -> Node:
        a = self.start
        n = self.assigned()
        while self.is_(","):
            self.take()
            n = self.node("sequence_expression", a, (None, n), (None, self.assigned()))
        return n

    def assigned(self) -> Node:
        a = self.start
        if self.is_("yield"):
            self.take()
            self.skip("*")
            more = None if self.is_(")", "]", "}", ",", ";", ":") or self.new_line() else self.assigned()
            return self.node("yield_expression", a, (None, more))
        arrow = self.arrow()
        if arrow is not None:
            return arrow
        left = self.expression()
        if self.is_("?"):
            self.take()
            kept, self.no_in = self.no_in, False
            yes = self.assigned()
            self.no_in = kept
            self.take(":")
            return self.node("ternary_expression", a, ("condition", left), ("consequence", yes), ("alternative", self.assigned()))
        if self.kind == "op" and self.text in _ASSIGN:
            op = self.sign()
            right = self.assigned()
            if op.type == "=":
                return self.node("assignment_expression", a, ("left", left), ("right", right))
            return self.node("augmented_assignment_expression", a, ("left", left), ("operator", op), ("right", right))
        return left

    def new_line(self) -> bool:
        return self.at >= len(self.tokens) or self.tokens[self.at][4]

    def arrow(self) -> Node | None:
        a, back = self.start, self.at
        if self.is_("async") and not (self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][4]) and (self.ahead() == "(" or self.ahead_kind() == "id"):
            self.at += 1
        if self.kind == "id" and self.ahead() == "=>":
            single = self.name()
            self.take("=>")
            return self.node("arrow_function", a, ("parameter", single), ("body", self.body()))
        if self.typed and self.is_("<"):
            try:
                self.type_arguments("type_parameters")
            except _Wrong:
                self.at = back
                return None
        if self.is_("(") and self.at in self.match:
            behind = self.match[self.at] + 1
            here = self.at
            if behind < len(self.tokens) and (self.tokens[behind][1] == "=>" or (self.typed and self.tokens[behind][1] == ":")) and ("arrow", here) not in self.failed:
                try:
                    parameters = self.parameters()
                    result = self.annotation(arrow=True)
                    self.take("=>")
                except _Wrong:
                    self.failed.add(("arrow", here))
                    self.at = back
                    return None
                return self.node("arrow_function", a, ("parameters", parameters), ("return_type", result), ("body", self.body()))
            self.at = here
        self.at = back
        return None

    def body(self) -> Node:
        return self.block() if self.is_("{") else self.assigned()

    def prefix(self) -> Node:
        a = self.start
        if self.is_("await") and not self.ahead() in (")", ";", ",", "=", "."):
            self.take()
            return self.node("await_expression", a, (None, self.prefix()))
        if self.is_("++", "--"):
            op = self.sign()
            return self.node("update_expression", a, ("operator", op), ("argument", self.prefix()))
        if self.typed and self.is_("<") and self.ahead_kind() == "id":
            kind = self.type_arguments()
            return self.node("type_assertion", a, (None, kind), (None, self.prefix()))
        return super().prefix()

    def string(self) -> Node:
        n = self.leaf("string")
        if n.end - n.start > 2:
            n.children.append((None, Node("string_fragment", n.start + 1, n.end - 1)))
        return n

    def template(self) -> Node:
        n = self.leaf("template_string")
        at = n.start + 1
        while at < n.end - 1:
            if self.source[at] == "\\":
                at += 2
            elif self.source.startswith("${", at):
                inside = type(self)(self.source, at + 2, n.end - 1)
                depth = 0
                for k, t in enumerate(inside.tokens):
                    if t[0] == "op" and t[1] == "{":
                        depth += 1
                    elif t[0] == "op" and t[1] == "}":
                        if not depth:
                            stop = t[3]
                            inner = type(self)(self.source, at + 2, t[2])
                            kids = inner.statements(lambda: False, inner.whole)
                            n.children.append((None, Node("template_substitution", at, stop, kids)))
                            at = stop
                            break
                        depth -= 1
                else:
                    return n
            else:
                at += 1
        return n

    def primary(self) -> Node:
        a, kind, text = self.start, self.kind, self.text
        if kind == "num":
            return self.leaf("number")
        if kind == "str":
            return self.string()
        if kind == "template":
            return self.template()
        if kind == "regex":
            n = self.leaf("regex")
            n.children.append(("pattern", Node("regex_pattern", a + 1, self.source.rindex("/", a, n.end))))
            return n
        if text == "(":
            return self.inner()
        if text == "[":
            return self.listed("array", self.item)
        if text == "{":
            return self.listed("object", self.member)
        if kind != "id":
            raise _Wrong
        if text in ("function", "async") and (text == "function" or (self.ahead() == "function")):
            return self.function("function_expression", "generator_function")
        if text == "class":
            return self.class_("class")
        if text == "new":
            self.take()
            if self.is_("."):
                self.take()
                self.name()
                return self.node("meta_property", a)
            made = self.primary()
            while self.is_(".", "["):
                made = self.step(made)
            if self.typed and self.is_("<"):
                self.type_arguments()
            arguments = self.arguments() if self.is_("(") else None
            return self.node("new_expression", a, ("constructor", made), ("arguments", arguments))
        if text == "import" and self.ahead() in ("(", "."):
            return self.leaf("import")
        if text in ("this", "super", "true", "false", "null", "undefined"):
            return self.leaf(text)
        if text in self.keywords:
            raise _Wrong
        if text.startswith("#"):
            return self.leaf("private_property_identifier")
        if text.startswith("@"):
            raise _Wrong
        return self.leaf("identifier")

    def item(self) -> Node:
        if self.is_("..."):
            a = self.start
            self.take()
            return self.node("spread_element", a, (None, self.assigned()))
        return self.assigned()

    def key(self) -> Node:
        if self.kind == "str":
            return self.string()
        if self.kind == "num":
            return self.leaf("number")
        if self.is_("["):
            a = self.start
            self.take()
            n = self.assigned()
            self.take("]")
            return self.node("computed_property_name", a, (None, n))
        return self.name("private_property_identifier" if self.text.startswith("#") else "property_identifier")

    def member(self) -> Node:
        a = self.start
        if self.is_("..."):
            return self.item()
        method = self.method(a)
        if method is not None:
            return method
        if self.kind == "id" and self.ahead() in (",", "}"):
            return self.leaf("shorthand_property_identifier")
        if self.kind == "id" and self.ahead() == "=":
            left = self.leaf("shorthand_property_identifier_pattern")
            self.take("=")
            return self.node("object_assignment_pattern", a, ("left", left), ("right", self.assigned()))
        key = self.key()
        self.take(":")
        return self.node("pair", a, ("key", key), ("value", self.assigned()))

    _modifiers = frozenset("static async get set".split())

    def method(self, a: int) -> Node | None:
        """name(parameters) { body }, with its modifiers; None, and nothing taken, where there is none."""
        back = self.at
        while self.kind == "id" and self.text in self._modifiers and self.ahead() not in ("(", ":", ",", "}", "=", ";", "<", "?", "!"):
            self.at += 1
        self.skip("*")
        try:
            name = self.key()
            self.typed and self.skip("?", "!")
            if self.typed and self.is_("<"):
                self.type_arguments("type_parameters")
            if not self.is_("("):
                raise _Wrong
            parameters = self.parameters()
            result = self.annotation()
            if self.is_("{"):
                return self.node("method_definition", a, ("name", name), ("parameters", parameters), ("return_type", result), ("body", self.block()))
            if self.typed:
                return self.node("method_signature", a, ("name", name), ("parameters", parameters), ("return_type", result))
            raise _Wrong
        except _Wrong:
            self.at = back
            return None

    def arguments(self) -> Node:
        return self.listed("arguments", self.item)

    def step(self, n: Node) -> Node:
        """One member or index of ``n``."""
        if self.skip(".", "?."):
            if self.is_("("):
                return self.node("call_expression", n.start, ("function", n), ("arguments", self.arguments()))
            if self.is_("["):
                return self.step(n)
            return self.node("member_expression", n.start, ("object", n), ("property", self.name("private_property_identifier" if self.text.startswith("#") else "property_identifier")))
        self.take("[")
        kept, self.no_in = self.no_in, False
        index = self.whole()
        self.no_in = kept
        self.take("]")
        return self.node("subscript_expression", n.start, ("object", n), ("index", index))

    def postfix(self, n: Node) -> Node:
        while self.at < len(self.tokens):
            if self.is_(".", "?.", "["):
                n = self.step(n)
            elif self.is_("("):
                n = self.node("call_expression", n.start, ("function", n), ("arguments", self.arguments()))
            elif self.kind == "template":
                n = self.node("call_expression", n.start, ("function", n), ("arguments", self.template()))
            elif self.is_("++", "--") and not self.new_line():
                op = self.sign()
                n = self.node("update_expression", n.start, ("argument", n), ("operator", op))
            elif self.typed and self.is_("!") and not self.new_line() and self.ahead() not in ("=",):
                self.take()
                n = self.node("non_null_expression", n.start, (None, n))
            elif self.typed and self.is_("as", "satisfies") and not self.new_line():
                word = self.take()[1]
                n = self.node(f"{word}_expression", n.start, (None, n), (None, self.type_()))
            elif self.typed and self.is_("<") and (call := self.generic_call(n)):
                n = call
            else:
                break
        return n

    def generic_call(self, n: Node) -> Node | None:
        back = self.at
        if ("generic", back) in self.failed:
            return None
        try:
            kinds = self.type_arguments()
            if not self.is_("("):
                raise _Wrong
            return self.node("call_expression", n.start, ("function", n), ("type_arguments", kinds), ("arguments", self.arguments()))
        except _Wrong:
            self.failed.add(("generic", back))
            self.at = back
            return None

    # types

    def type_arguments(self, type_: str = "type_arguments") -> Node:
        a, depth, kids = self.start, 0, []
        while True:
            if self.is_("<"):
                depth += 1
            elif self.is_(">", ">>", ">>>"):
                depth -= len(self.text)
            elif self.kind == "op" and self.text in _OPEN:
                self.at = self.closing()
            elif self.kind == "op" and self.text not in (",", ".", "|", "&", "?", ":", "=>", "=", "...", "-"):
                raise _Wrong
            elif self.kind == "id":
                kids.append((None, Node("type_identifier", self.start, self.tokens[self.at][3])))
            self.take()
            if depth <= 0:
                return self.node(type_, a, *kids)

    def type_(self, arrow: bool = False) -> Node:
        first = self.at

        def stops() -> bool:
            if self.is_("=>"):
                return arrow or self.ahead(-1) != ")"
            if self.is_("{"):
                return self.at > first and self.ahead(-1) not in ("|", "&", "=>", "is", "extends", "?", ":", "keyof")
            if self.at > first and self.tokens[self.at][4] and not self.is_("|", "&", "?", ":", ".", "=>") and self.ahead(-1) not in ("|", "&", "=>", ":", "?", "extends"):
                return True
            return self.is_(",", "=", ")", "]", "}", ";", "&&", "||", "??", "==", "===", "!=", "!==", "+=", "of", "in") or (self.is_("?", ":") and "extends" not in [t[1] for t in self.tokens[first : self.at]])

        return self.balanced("type", stops)

    def annotation(self, arrow: bool = False) -> Node | None:
        if not self.typed or not self.is_(":"):
            return None
        a = self.start
        self.take()
        return self.node("type_annotation", a, (None, self.type_(arrow)))

    # functions and classes

    def parameters(self) -> Node:
        def one() -> Node:
            a = self.start
            self.decorators()
            while self.typed and self.is_("public", "private", "protected", "readonly", "override") and self.ahead_kind() == "id":
                self.take()
            if self.is_("..."):
                self.take()
                target = self.node("rest_pattern", a, (None, self.pattern()))
            else:
                target = self.pattern()
            optional = self.typed and self.skip("?")
            kind = self.annotation()
            value = self.assigned() if self.skip("=") else None
            if self.typed:
                return self.node("optional_parameter" if optional else "required_parameter", a, ("pattern", target), ("type", kind), ("value", value))
            return self.node("assignment_pattern", a, ("left", target), ("right", value)) if value else target

        return self.listed("formal_parameters", one)

    def pattern(self) -> Node:
        if self.is_("["):
            n = self.primary()
            n.type = "array_pattern"
            return n
        if self.is_("{"):
            n = self.primary()
            n.type = "object_pattern"
            for _, c in n.children:
                if c.type == "shorthand_property_identifier":
                    c.type = "shorthand_property_identifier_pattern"
                elif c.type == "pair":
                    c.type = "pair_pattern"
            return n
        if self.is_("this"):
            return self.leaf("this")
        return self.name()

    def function(self, type_: str, generator: str) -> Node:
        a = self.start
        self.skip("async")
        self.take("function")
        star = self.skip("*")
        name = self.name() if self.kind == "id" else None
        if self.typed and self.is_("<"):
            self.type_arguments("type_parameters")
        parameters = self.parameters()
        result = self.annotation()
        if self.typed and not self.is_("{"):
            self.skip(";")
            return self.node("function_signature", a, ("name", name), ("parameters", parameters), ("return_type", result))
        return self.node(generator if star else type_, a, ("name", name), ("parameters", parameters), ("return_type", result), ("body", self.block()))

    def decorators(self) -> list[tuple[str, Node]]:
        out = []
        while self.kind == "id" and self.text.startswith("@"):
            a = self.start
            n = self.leaf("identifier")
            n.start += 1
            out.append(("decorator", Node("decorator", a, 0, [(None, self.postfix(n))])))
            out[-1][1].end = self.behind
        return out

    def class_(self, type_: str, marks: list[tuple[str, Node]] | None = None) -> Node:
        a = marks[0][1].start if marks else self.start
        marks = marks or self.decorators()
        abstract = self.typed and self.skip("abstract")
        self.take("class")
        name = self.name("type_identifier" if self.typed else "identifier") if self.kind == "id" and not self.is_("extends", "implements") else None
        if self.typed and self.is_("<"):
            self.type_arguments("type_parameters")
        heritage = None
        if self.is_("extends", "implements"):
            b = self.start
            kids = []
            if self.skip("extends"):
                kids.append((None, self.postfix(self.primary()) if not self.typed else self.balanced("extends_clause", lambda: self.is_("{", "implements"))))
            if self.typed and self.skip("implements"):
                kids.append((None, self.balanced("implements_clause", lambda: self.is_("{"))))
            heritage = self.node("class_heritage", b, *kids)
        body = self.block("class_body", self.class_member)
        return self.node("abstract_class_declaration" if abstract and type_ == "class_declaration" else type_, a, *marks, ("name", name), (None, heritage), ("body", body))

    def class_member(self) -> Node | None:
        if self.skip(";"):
            return None
        a = self.start
        marks = self.decorators()
        if self.is_("static") and self.ahead() == "{":
            self.take()
            return self.node("class_static_block", a, ("body", self.block()))
        while self.typed and self.is_("public", "private", "protected", "readonly", "override", "abstract", "declare", "static") and self.ahead() not in ("(", "=", ":", ";", "?", "!"):
            self.take()
        method = self.method(a)
        if method is not None:
            method.children[:0] = marks
            return method
        if self.typed and self.is_("[") and (index := self.index_signature(a)):
            self.skip(";")
            return index
        while self.is_("static") and self.ahead() not in ("=", ";", "}"):
            self.take()
        name = self.key()
        self.typed and self.skip("?", "!")
        kind = self.annotation()
        value = self.assigned() if self.skip("=") else None
        self.skip(";", ",")
        return self.node("public_field_definition" if self.typed else "field_definition", a, *marks, ("name" if self.typed else "property", name), ("type", kind), ("value", value))

    def index_signature(self, a: int) -> Node | None:
        """[name: type]: type"""
        if self.ahead_kind() != "id" or self.ahead(2) not in (":", "in"):
            return None
        self.at = self.closing() + 1
        self.skip("?")
        return self.node("index_signature", a, ("type", self.annotation()))

    # statements

    def end(self) -> None:
        if not self.skip(";") and self.at < len(self.tokens) and not self.is_("}") and not self.new_line():
            raise _Wrong

    def declared(self) -> Node:
        a = self.start
        word = self.take()[1]
        kids = []
        while True:
            b = self.start
            name = self.pattern()
            self.typed and self.skip("!")
            kind = self.annotation()
            value = self.assigned() if self.skip("=") else None
            kids.append((None, self.node("variable_declarator", b, ("name", name), ("type", kind), ("value", value))))
            if not self.skip(","):
                break
        return self.node("variable_declaration" if word == "var" else "lexical_declaration", a, *kids)

    def statement(self) -> Node | None:
        self.no_in = False
        a, text = self.start, self.text if self.kind in ("id", "op") else ""
        if text == "{":
            return self.block()
        if text == ";":
            return self.leaf("empty_statement")
        if text in ("var", "const") or (text == "let" and (self.ahead_kind() == "id" or self.ahead() in ("[", "{"))):
            if text == "const" and self.ahead() == "enum" and self.typed:
                self.take()
                return self.typed_statement("enum", a)
            n = self.declared()
            self.end()
            n.end = self.behind
            return n
        if text == "function" or (text == "async" and self.ahead() == "function"):
            return self.function("function_declaration", "generator_function_declaration")
        if text.startswith("@"):
            marks = self.decorators()
            if not self.is_("export"):
                return self.class_("class_declaration", marks)
            n = self.export()
            n.start, n.children[:0] = a, marks
            return n
        if text == "class" or (self.typed and text == "abstract" and self.ahead() == "class"):
            return self.class_("class_declaration")
        if text in ("return", "throw"):
            self.take()
            value = None if self.is_(";", "}") or self.new_line() else self.whole()
            self.end()
            return self.node(f"{text}_statement", a, (None, value))
        if text in ("break", "continue", "debugger"):
            self.take()
            label = self.name("statement_identifier") if self.kind == "id" and not self.new_line() else None
            self.end()
            return self.node(f"{text}_statement", a, ("label", label))
        if text == "if":
            self.take()
            test, yes = self.inner(), self.statement()
            other = None
            if self.is_("else"):
                b = self.start
                self.take()
                other = self.node("else_clause", b, (None, self.statement()))
            return self.node("if_statement", a, ("condition", test), ("consequence", yes), ("alternative", other))
        if text == "while":
            self.take()
            return self.node("while_statement", a, ("condition", self.inner()), ("body", self.statement()))
        if text == "do":
            self.take()
            body = self.statement()
            self.take("while")
            test = self.inner()
            self.skip(";")
            return self.node("do_statement", a, ("body", body), ("condition", test))
        if text == "for":
            return self.for_()
        if text == "try":
            self.take()
            body, handler, last = self.block(), None, None
            if self.is_("catch"):
                b = self.start
                self.take()
                name = None
                if self.skip("("):
                    name = self.pattern()
                    self.annotation()
                    self.take(")")
                handler = self.node("catch_clause", b, ("parameter", name), ("body", self.block()))
            if self.is_("finally"):
                b = self.start
                self.take()
                last = self.node("finally_clause", b, ("body", self.block()))
            return self.node("try_statement", a, ("body", body), ("handler", handler), ("finalizer", last))
        if text == "switch":
            self.take()
            value = self.inner()
            return self.node("switch_statement", a, ("value", value), ("body", self.block("switch_body", self.case)))
        if text == "import" and self.ahead() not in ("(", "."):
            return self.import_()
        if text == "export":
            return self.export()
        if self.typed and text in ("interface", "type", "enum", "namespace", "module", "declare") and (self.ahead_kind() == "id" or (text == "module" and self.ahead_kind() == "str")) and not self.tokens[self.at + 1][4]:
            return self.typed_statement(text, a)
        if self.kind == "id" and self.ahead() == ":" and text not in self.keywords:
            label = self.leaf("statement_identifier")
            self.take(":")
            return self.node("labeled_statement", a, ("label", label), ("body", self.statement()))
        n = self.whole()
        self.end()
        return self.node("expression_statement", a, (None, n))

    def typed_statement(self, word: str, a: int) -> Node:
        self.take(word)
        if word == "declare":
            return self.node("ambient_declaration", a, (None, self.statement()))
        if word in ("namespace", "module"):
            name = self.postfix(self.primary())
            return self.node("internal_module" if word == "namespace" else "module", a, ("name", name), ("body", self.block()))
        name = self.name("identifier" if word == "enum" else "type_identifier")
        if word == "enum":
            def one() -> Node | tuple[str, Node]:
                b = self.start
                key = self.key()
                return self.node("enum_assignment", b, ("name", key), ("value", self.assigned())) if self.skip("=") else ("name", key)

            return self.node("enum_declaration", a, ("name", name), ("body", self.listed("enum_body", one)))
        if self.is_("<"):
            self.type_arguments("type_parameters")
        if word == "type":
            self.take("=")
            kind = self.type_()
            self.end()
            return self.node("type_alias_declaration", a, ("name", name), ("value", kind))
        parents = None
        if self.is_("extends"):
            parents = self.balanced("extends_type_clause", lambda: self.is_("{"))
        b, end = self.start, self.closing() if self.is_("{") else -1
        self.take("{")
        kids = []
        while self.at < end:
            if self.skip(";", ","):
                continue
            c, back = self.start, self.at
            self.skip("readonly")
            method = self.method(c)
            if method is None and self.is_("["):
                method = self.index_signature(c)
            if method is None:
                try:
                    key = self.key()
                    self.skip("?")
                    method = self.node("property_signature", c, ("name", key), ("type", self.annotation()))
                except _Wrong:
                    method = self.error(c, back)
            kids.append((None, method))
            if self.at == back:
                self.at += 1
        self.at = end + 1
        return self.node("interface_declaration", a, ("name", name), (None, parents), ("body", self.node("interface_body", b, *kids)))

    def for_(self) -> Node:
        a = self.start
        self.take("for")
        self.skip("await")
        end = self.closing()
        self.take("(")
        first = None
        word = self.text if self.is_("var", "let", "const") else None
        at = self.at
        while at < end and not (self.tokens[at][0] == "op" and self.tokens[at][1] == ";") and not (at > self.at and self.tokens[at][1] in ("of", "in") and self.tokens[at][0] == "id"):
            at = self.match.get(at, at) + 1
        if at < end and self.tokens[at][1] != ";":
            if word:
                self.take()
                left = self.pattern()
                self.annotation()
            else:
                left = self.postfix(self.primary())
            op = self.sign()
            right = self.whole()
            self.take(")")
            return self.node("for_in_statement", a, ("left", left), ("operator", op), ("right", right), ("body", self.statement()))
        self.no_in = True
        if not self.is_(";"):
            first = self.declared() if word else self.whole()
        self.no_in = False
        self.take(";")
        test = None if self.is_(";") else self.whole()
        self.take(";")
        more = None if self.is_(")") else self.whole()
        self.take(")")
        return self.node("for_statement", a, ("initializer", first), ("condition", test), ("increment", more), ("body", self.statement()))

    def case(self) -> Node:
        a = self.start
        value = None
        if self.take()[1] == "case":
            value = self.whole()
        self.take(":")
        end = self.statements(lambda: self.is_("case", "default", "}"))
        return self.node("switch_case" if value else "switch_default", a, ("value", value), *(("body", n) for _, n in end))

    def import_(self) -> Node:
        a = self.start
        self.take("import")
        kids: list[tuple[str | None, Node]] = []
        if self.kind != "str":
            self.typed and self.is_("type") and self.ahead() != "from" and self.take()
            b, names = self.start, []
            while not self.is_("from"):
                if self.is_("{"):
                    names.append((None, self.listed("named_imports", self.specifier("import_specifier"))))
                elif self.is_("*"):
                    c = self.start
                    self.take()
                    self.take("as")
                    names.append((None, self.node("namespace_import", c, (None, self.name()))))
                elif not self.skip(","):
                    names.append((None, self.name()))
                if self.typed and self.is_("="):
                    self.take()
                    value = self.whole()
                    self.end()
                    return self.node("import_statement", a, *names, (None, value))
            kids.append((None, self.node("import_clause", b, *names)))
            self.take("from")
        if self.kind != "str":
            raise _Wrong
        kids.append(("source", self.string()))
        if self.is_("with", "assert") and self.ahead() == "{":
            self.take()
            self.primary()
        self.end()
        return self.node("import_statement", a, *kids)

    def specifier(self, type_: str) -> Callable[[], Node]:
        def one() -> Node:
            a = self.start
            self.typed and self.is_("type") and self.ahead_kind() == "id" and self.ahead() != "as" and self.take()
            name = self.string() if self.kind == "str" else self.name()
            alias = None
            if self.skip("as"):
                alias = self.string() if self.kind == "str" else self.name()
            return self.node(type_, a, ("name", name), ("alias", alias))

        return one

    def export(self) -> Node:
        a = self.start
        self.take("export")
        if self.typed and self.is_("type") and self.ahead() in ("{", "*"):
            self.take()
        if self.skip("default"):
            if self.is_("function", "class", "abstract") or (self.is_("async") and self.ahead() == "function"):
                return self.node("export_statement", a, ("declaration" if self.ahead() not in ("(", "{", "*") else "value", self.statement()))
            value = self.whole()
            self.end()
            return self.node("export_statement", a, ("value", value))
        if self.is_("{", "*"):
            clause = None
            if self.is_("{"):
                clause = self.listed("export_clause", self.specifier("export_specifier"))
            else:
                b = self.start
                self.take()
                if self.skip("as"):
                    clause = self.node("namespace_export", b, (None, self.name()))
            source = self.string() if self.skip("from") and self.kind == "str" else None
            self.end()
            return self.node("export_statement", a, (None, clause), ("source", source))
        return self.node("export_statement", a, ("declaration", self.statement()))


class TypeScript(JavaScript):
    typed = True


# --- Java

class Java(Reader):
    comment = ("line_comment", "block_comment")
    block_type, operand = "block", "operand"
    unary = frozenset("! ~ + -".split())
    _modifiers = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
    _basic = {**dict.fromkeys("int long short byte char".split(), "integral_type"), **dict.fromkeys("float double".split(), "floating_point_type"), "boolean": "boolean_type", "void": "void_type"}
    keywords = frozenset("assert break case catch class continue do else enum extends finally for if implements import instanceof interface new package return switch throw throws try while".split()) | (
        _modifiers - {"default", "sealed"}
    )

    def special(self, at: int) -> tuple[str, int] | None:
        if self.source.startswith('"""', at):
            return "str", _RAW.match(self.source, at).end()
        return None

    # types

    def type_(self) -> Node:
        a = self.start
        while self.kind == "id" and self.text.startswith("@"):
            self.annotation()
        if self.kind != "id" or self.text in self.keywords:
            raise _Wrong
        n = self.leaf(self._basic.get(self.text, "type_identifier"))
        while True:
            if self.is_("<"):
                b, depth, kids = self.start, 0, []
                while True:
                    if self.is_("<"):
                        depth += 1
                    elif self.is_(">", ">>", ">>>"):
                        depth -= len(self.text)
                    elif self.kind == "id":
                        kids.append((None, Node("type_identifier", self.start, self.tokens[self.at][3])))
                    elif not self.is_(",", ".", "?", "&", "[", "]"):
                        raise _Wrong
                    self.take()
                    if depth <= 0:
                        break
                n = self.node("generic_type", a, (None, n), (None, self.node("type_arguments", b, *kids)))
            elif self.is_(".") and self.ahead_kind() == "id":
                self.take()
                n = self.node("scoped_type_identifier", a, (None, n), (None, self.leaf("type_identifier")))
            elif self.is_("[") and self.ahead() == "]":
                b = self.start
                self.at += 2
                n = self.node("array_type", a, ("element", n), ("dimensions", self.node("dimensions", b)))
            else:
                return n

    def annotation(self) -> Node:
        a = self.start
        n = self.leaf("identifier")
        n.start += 1
        while self.is_(".") and self.ahead_kind() == "id":
            self.take()
            n = self.node("scoped_identifier", n.start, ("scope", n), ("name", self.leaf("identifier")))
        if not self.is_("("):
            return self.node("marker_annotation", a, ("name", n))

        def one() -> Node:
            b = self.start
            if self.kind == "id" and self.ahead() == "=":
                key = self.leaf("identifier")
                self.take()
                return self.node("element_value_pair", b, ("key", key), ("value", self.value()))
            return self.value()

        return self.node("annotation", a, ("name", n), ("arguments", self.listed("annotation_argument_list", one)))

    def value(self) -> Node:
        if self.is_("{"):
            return self.listed("array_initializer", self.value)
        if self.kind == "id" and self.text.startswith("@"):
            return self.annotation()
        return self.whole()

    def modifiers(self) -> Node | None:
        a, kids, any_ = self.start, [], False
        while self.kind == "id":
            if self.text.startswith("@") and self.text != "@interface":
                kids.append((None, self.annotation()))
            elif self.text in self._modifiers and not (self.text == "default" and self.ahead() in (":", "->")) and not (self.text == "synchronized" and self.ahead() == "("):
                kids.append((None, self.sign()))
            elif self.text == "non" and self.ahead() == "-":
                self.at += 3
            else:
                break
            any_ = True
        return self.node("modifiers", a, *kids) if any_ else None

    # expressions

    def whole(self) -> Node:
        a = self.start
        if self.kind == "id" and self.ahead() == "->":
            name = self.name()
            self.take()
            return self.node("lambda_expression", a, ("parameters", name), ("body", self.block() if self.is_("{") else self.whole()))
        if self.is_("(") and self.at in self.match and self.match[self.at] + 1 < len(self.tokens) and self.tokens[self.match[self.at] + 1][1] == "->":
            back = self.at
            try:
                names = self.listed("inferred_parameters", self.name)
            except _Wrong:
                self.at = back
                names = self.parameters()
            self.take("->")
            return self.node("lambda_expression", a, ("parameters", names), ("body", self.block() if self.is_("{") else self.whole()))
        left = self.expression()
        if self.is_("?"):
            self.take()
            yes = self.whole()
            self.take(":")
            return self.node("ternary_expression", a, ("condition", left), ("consequence", yes), ("alternative", self.whole()))
        if self.kind == "op" and self.text in _ASSIGN:
            op = self.sign()
            return self.node("assignment_expression", a, ("left", left), ("operator", op), ("right", self.whole()))
        return left

    def binary(self, a: int, left: Node, op: Node, right: Node) -> Node:
        if op.type == "instanceof":
            return self.node("instanceof_expression", a, ("left", left), ("right", right))
        return super().binary(a, left, op, right)

    def expression(self, level: int = 0) -> Node:
        if level == _LEVELS["instanceof"] and self.ahead(-1) == "instanceof":
            self.skip("final")
            n = self.type_()
            if self.kind == "id" and self.text not in self.keywords:
                self.take()
            elif self.is_("("):
                self.at = self.closing() + 1
            return n
        return super().expression(level)

    def prefix(self) -> Node:
        a = self.start
        if self.is_("++", "--"):
            self.sign()
            return self.node("update_expression", a, (None, self.prefix()))
        if self.is_("(") and (cast := self.cast()):
            return cast
        return super().prefix()

    def cast(self) -> Node | None:
        a, back = self.start, self.at
        if ("cast", back) in self.failed:
            return None
        try:
            self.take("(")
            basic = self.text in self._basic
            kind = self.type_()
            while self.skip("&"):
                self.type_()
            self.take(")")
            if not (basic or self.kind in ("id", "str", "num") or self.is_("(", "!", "~")) or self.is_("instanceof"):
                raise _Wrong
            value = self.whole() if self.kind == "id" and self.ahead() == "->" else self.prefix()
            return self.node("cast_expression", a, ("type", kind), ("value", value))
        except _Wrong:
            self.failed.add(("cast", back))
            self.at = back
            return None

    def arguments(self) -> Node:
        return self.listed("argument_list", self.whole)

    def primary(self) -> Node:
        a, kind, text = self.start, self.kind, self.text
        if kind == "num":
            hexed = text[:2].lower() == "0x"
            if hexed:
                return self.leaf("hex_integer_literal")
            return self.leaf("decimal_floating_point_literal" if "." in text or text[-1] in "fFdD" or "e" in text.lower() else "binary_integer_literal" if text[:2].lower() == "0b" else "decimal_integer_literal")
        if kind == "str":
            if text[0] == "'":
                return self.leaf("character_literal")
            n = self.leaf("string_literal")
            if n.end - n.start > 2:
                n.children.append((None, Node("string_fragment", n.start + 1, n.end - 1)))
            return n
        if text == "(":
            return self.inner()
        if text == "switch":
            return self.switch("switch_expression")
        if kind != "id":
            raise _Wrong
        if text == "new":
            self.take()
            made = self.type_base()
            if self.is_("["):
                kids: list[tuple[str | None, Node]] = [("type", made)]
                while self.is_("["):
                    b = self.start
                    self.take()
                    size = None if self.is_("]") else self.whole()
                    self.take("]")
                    kids.append(("dimensions", self.node("dimensions_expr" if size else "dimensions", b, (None, size))))
                if self.is_("{"):
                    kids.append(("value", self.listed("array_initializer", self.value)))
                return self.node("array_creation_expression", a, *kids)
            arguments = self.arguments()
            body = self.block("class_body", self.class_member) if self.is_("{") else None
            return self.node("object_creation_expression", a, ("type", made), ("arguments", arguments), (None, body))
        if text in ("this", "super", "true", "false"):
            return self.leaf(text)
        if text == "null":
            return self.leaf("null_literal")
        if text in self._basic:
            return self.type_()
        if text in self.keywords or text.startswith("@"):
            raise _Wrong
        if self.ahead() == "(":
            name = self.leaf("identifier")
            return self.node("method_invocation", a, ("name", name), ("arguments", self.arguments()))
        if self.ahead() in ("<", "["):  # a type before :: or .class
            back = self.at
            try:
                n = self.type_()
                if self.is_("::") or (self.is_(".") and self.ahead() == "class"):
                    return n
            except _Wrong:
                pass
            self.at = back
        return self.leaf("identifier")

    def type_base(self) -> Node:
        """A type without the brackets of an array."""
        a = self.start
        if self.kind != "id":
            raise _Wrong
        n = self.leaf(self._basic.get(self.text, "type_identifier"))
        while self.is_(".") and self.ahead_kind() == "id":
            self.take()
            n = self.node("scoped_type_identifier", a, (None, n), (None, self.leaf("type_identifier")))
        if self.is_("<"):
            b, depth = self.start, 0
            while True:
                depth += self.text == "<"
                depth -= len(self.text) if self.is_(">", ">>", ">>>") else 0
                self.take()
                if depth <= 0:
                    break
            n = self.node("generic_type", a, (None, n), (None, self.node("type_arguments", b)))
        return n

    def postfix(self, n: Node) -> Node:
        while self.at < len(self.tokens):
            if self.is_("."):
                self.take()
                if self.is_("new"):
                    made = self.primary()
                    n = self.node("object_creation_expression", n.start, (None, n), *made.children)
                    continue
                if self.is_("class"):
                    self.take()
                    n = self.node("class_literal", n.start, (None, n))
                    continue
                if self.is_("<"):
                    depth = 0
                    while True:
                        depth += self.text == "<"
                        depth -= len(self.text) if self.is_(">", ">>", ">>>") else 0
                        self.take()
                        if depth <= 0:
                            break
                name = self.leaf(self.text) if self.is_("this", "super") else self.name()
                if self.is_("("):
                    n = self.node("method_invocation", n.start, ("object", n), ("name", name), ("arguments", self.arguments()))
                else:
                    n = self.node("field_access", n.start, ("object", n), ("field", name))
            elif self.is_("["):
                self.take()
                index = self.whole()
                self.take("]")
                n = self.node("array_access", n.start, ("array", n), ("index", index))
            elif self.is_("++", "--"):
                self.sign()
                n = self.node("update_expression", n.start, (None, n))
            elif self.is_("::"):
                self.take()
                n = self.node("method_reference", n.start, (None, n), (None, self.leaf("new") if self.is_("new") else self.name()))
            elif self.is_("(") and n.type in ("this", "super"):
                n = self.node("explicit_constructor_invocation", n.start, ("constructor", n), ("arguments", self.arguments()))
            else:
                break
        return n

    # declarations

    def parameters(self) -> Node:
        def one() -> Node:
            a = self.start
            marks, kind = self.modifiers(), self.type_()
            spread = self.skip("...")
            name = self.name(self.text if self.is_("this") else "identifier")
            while self.is_("["):
                self.at = self.closing() + 1
            return self.node("spread_parameter" if spread else "formal_parameter", a, (None, marks), ("type", kind), ("name", name))

        return self.listed("formal_parameters", one)

    def declarators(self, type_: str, a: int, marks: Node | None, kind: Node, end: bool = True) -> Node:
        kids = []
        while True:
            b = self.start
            name = self.name()
            while self.is_("["):
                self.at = self.closing() + 1
            value = self.value() if self.skip("=") else None
            kids.append(("declarator", self.node("variable_declarator", b, ("name", name), ("value", value))))
            if not self.skip(","):
                break
        if end:
            self.take(";")
        return self.node(type_, a, (None, marks), ("type", kind), *kids)

    def type_declaration(self, a: int, marks: Node | None) -> Node:
        word = self.take()[1]
        name = self.name()
        kids: list[tuple[str | None, Node | None]] = [(None, marks), ("name", name)]
        if self.is_("<"):
            kids.append(("type_parameters", self.balanced("type_parameters", lambda: self.is_("{", "(", "extends", "implements"))))
        if word == "record":
            kids.append(("parameters", self.parameters()))
        while self.is_("extends", "implements", "permits"):
            b, clause = self.start, self.take()[1]
            fields = {"extends": ("superclass", "superclass") if word == "class" else (None, "extends_interfaces"), "implements": ("interfaces", "super_interfaces"), "permits": ("permits", "permits")}[clause]
            inside = self.balanced(fields[1], lambda: self.is_("{", "implements", "permits"))
            inside.start = b
            kids.append((fields[0], inside))
        if word == "enum":
            body = self.enum_body()
        else:
            body = self.block({"class": "class_body", "record": "class_body", "interface": "interface_body"}.get(word, "annotation_type_body"), self.class_member)
        return self.node({"@interface": "annotation_type_declaration"}.get(word, f"{word}_declaration"), a, *kids, ("body", body))

    def enum_body(self) -> Node:
        a, end, kids = self.start, self.closing() if self.is_("{") else -1, []
        self.take("{")
        while self.at < end and not self.is_(";"):
            if self.skip(","):
                continue
            b = self.start
            marks, name = self.modifiers(), self.name()
            arguments = self.arguments() if self.is_("(") else None
            body = self.block("class_body", self.class_member) if self.is_("{") else None
            kids.append((None, self.node("enum_constant", b, (None, marks), ("name", name), ("arguments", arguments), ("body", body))))
        if self.skip(";"):
            kids += self.statements(lambda: self.at >= end, self.class_member)
        self.at = end + 1
        return self.node("enum_body", a, *kids)

    def class_member(self) -> Node | None:
        if self.skip(";"):
            return None
        a = self.start
        if self.is_("static") and self.ahead() == "{":
            self.take()
            return self.node("static_initializer", a, (None, self.block()))
        if self.is_("{"):
            return self.block()
        marks = self.modifiers()
        if self.declares():
            return self.type_declaration(a, marks)
        if self.is_("<"):
            self.balanced("type_parameters", lambda: self.ahead(-1) in (">", ">>"))
        if self.kind == "id" and self.ahead() in ("(", "{"):  # a constructor
            name = self.name()
            parameters = self.parameters() if self.is_("(") else None
            self.throws()
            return self.node("constructor_declaration", a, (None, marks), ("name", name), ("parameters", parameters), ("body", self.block("constructor_body")))
        kind = self.type_()
        if self.ahead() == "(":
            name, parameters = self.name(), self.parameters()
            while self.is_("["):
                self.at = self.closing() + 1
            thrown = self.throws()
            if self.skip("default"):
                self.value()
            body = self.block() if self.is_("{") else None
            if body is None:
                self.take(";")
            return self.node("method_declaration", a, (None, marks), ("type", kind), ("name", name), ("parameters", parameters), (None, thrown), ("body", body))
        return self.declarators("field_declaration", a, marks, kind)

    def throws(self) -> Node | None:
        return self.balanced("throws", lambda: self.is_("{", ";", "default")) if self.is_("throws") else None

    def declares(self) -> bool:
        return self.is_("class", "interface", "enum", "@interface") or (self.is_("record") and self.ahead_kind() == "id" and self.ahead(2) in ("(", "<"))

    # statements

    def switch(self, type_: str) -> Node:
        a = self.start
        self.take("switch")
        value = self.inner()
        return self.node(type_, a, ("condition", value), ("body", self.block("switch_block", self.case)))

    def case(self) -> Node:
        a = self.start
        if not self.is_("case", "default"):
            raise _Wrong
        labels = []
        arrow = False
        while self.is_("case", "default"):
            b = self.start
            kids = []
            if self.take()[1] == "case":
                kids.append((None, self.expression()))
                while self.skip(","):
                    kids.append((None, self.expression()))
            labels.append((None, self.node("switch_label", b, *kids)))
            arrow = self.skip("->")
            if arrow or not self.skip(":"):
                break
        if arrow:
            return self.node("switch_rule", a, *labels, (None, self.statement()))
        return self.node("switch_block_statement_group", a, *labels, *self.statements(lambda: self.is_("case", "default", "}")))

    def statement(self) -> Node | None:
        a, text = self.start, self.text if self.kind in ("id", "op") else ""
        if text == "{":
            return self.block()
        if text == ";":
            self.take()
            return None
        if text in ("import", "package"):
            self.take()
            self.skip("static")
            name: Node = self.name()
            while self.is_("."):
                self.take()
                if self.is_("*"):
                    self.leaf("asterisk")
                    break
                name = self.node("scoped_identifier", name.start, ("scope", name), ("name", self.name()))
            self.take(";")
            return self.node(f"{text}_declaration", a, (None, name))
        if text == "if":
            self.take()
            test, yes = self.inner(), self.statement()
            other = self.statement() if self.skip("else") else None
            return self.node("if_statement", a, ("condition", test), ("consequence", yes), ("alternative", other))
        if text == "while":
            self.take()
            return self.node("while_statement", a, ("condition", self.inner()), ("body", self.statement()))
        if text == "do":
            self.take()
            body = self.statement()
            self.take("while")
            test = self.inner()
            self.take(";")
            return self.node("do_statement", a, ("body", body), ("condition", test))
        if text == "for":
            return self.for_()
        if text == "switch":
            n = self.switch("switch_expression")
            self.skip(";")
            return n
        if text == "synchronized" and self.ahead() == "(":
            self.take()
            return self.node("synchronized_statement", a, (None, self.inner()), ("body", self.block()))
        if text == "try":
            return self.try_()
        if text in ("return", "throw", "yield") and not (text == "yield" and self.ahead() in ("=", ".", "(", "++", "--")):
            self.take()
            value = None if self.is_(";") else self.whole()
            self.take(";")
            return self.node(f"{text}_statement", a, (None, value))
        if text in ("break", "continue"):
            self.take()
            label = self.name() if self.kind == "id" else None
            self.take(";")
            return self.node(f"{text}_statement", a, (None, label))
        if text == "assert":
            self.take()
            test = self.whole()
            more = self.whole() if self.skip(":") else None
            self.take(";")
            return self.node("assert_statement", a, (None, test), (None, more))
        if self.kind == "id" and self.ahead() == ":":
            label = self.name()
            self.take(":")
            return self.node("labeled_statement", a, (None, label), (None, self.statement()))
        marks = self.modifiers()
        if self.declares():
            return self.type_declaration(a, marks)
        local = self.local(a, marks)
        if local is not None:
            return local
        n = self.whole()
        self.take(";")
        return n if n.type == "explicit_constructor_invocation" else self.node("expression_statement", a, (None, n))

    def local(self, a: int, marks: Node | None, end: bool = True) -> Node | None:
        back = self.at
        try:
            kind = self.type_()
            if self.kind != "id" or self.text in self.keywords or self.ahead() not in ("=", ";", ",", "[", ":"):
                raise _Wrong
        except _Wrong:
            if marks is not None:
                raise
            self.at = back
            return None
        return self.declarators("local_variable_declaration", a, marks, kind, end) if end or self.ahead() != ":" else Node("", a, a, [("type", kind), ("name", self.name())])

    def for_(self) -> Node:
        a = self.start
        self.take("for")
        self.take("(")
        b = self.start
        first = None if self.is_(";") else self.local(b, self.modifiers(), False)
        if first is not None and first.type == "":
            self.take(":")
            value = self.whole()
            self.take(")")
            return self.node("enhanced_for_statement", a, *first.children, ("value", value), ("body", self.statement()))
        kids: list[tuple[str | None, Node | None]] = [("init", first)]
        while not self.is_(";"):
            kids.append(("init", self.whole()))
            if not self.skip(","):
                break
        self.take(";")
        kids.append(("condition", None if self.is_(";") else self.whole()))
        self.take(";")
        while not self.is_(")"):
            kids.append(("update", self.whole()))
            if not self.skip(","):
                break
        self.take(")")
        return self.node("for_statement", a, *kids, ("body", self.statement()))

    def try_(self) -> Node:
        a = self.start
        self.take("try")
        held = None
        if self.is_("("):
            def one() -> Node:
                b = self.start
                n = self.local(b, self.modifiers(), False) or self.whole()
                n.type = "resource"
                return n

            held = self.listed("resource_specification", one)
        kids: list[tuple[str | None, Node | None]] = [("resources", held), ("body", self.block())]
        while self.is_("catch"):
            b = self.start
            self.take()
            c = self.start
            self.take("(")
            marks = self.modifiers()
            kinds = [(None, self.type_())]
            while self.skip("|"):
                kinds.append((None, self.type_()))
            name = self.name()
            self.take(")")
            parameter = Node("catch_formal_parameter", c + 1, name.end, [x for x in ((None, marks), (None, Node("catch_type", kinds[0][1].start, kinds[-1][1].end, kinds)), ("name", name)) if x[1] is not None])
            kids.append((None, self.node("catch_clause", b, (None, parameter), ("body", self.block()))))
        if self.is_("finally"):
            b = self.start
            self.take()
            kids.append((None, self.node("finally_clause", b, (None, self.block()))))
        return self.node("try_with_resources_statement" if held else "try_statement", a, *kids)


# --- Go

class Go(Reader):
    levels = _GO_LEVELS
    unary = frozenset("! ^ + - * & <-".split())
    block_type, root, operand = "block", "source_file", "operand"
    keywords = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
    bare = False  # whether a brace opens a block rather than a literal's body

    def special(self, at: int) -> tuple[str, int] | None:
        if self.source[at] == "`":
            stop = self.source.find("`", at + 1)
            return "raw", len(self.source) if stop < 0 else stop + 1
        return None

    def ended(self) -> None:
        """A line's end closes the statement, unless it can't end there."""
        if self.tokens:
            kind, text, _, b, _ = self.tokens[-1]
            ends = kind in ("num", "str", "raw") or (kind == "id" and (text not in self.keywords or text in ("break", "continue", "fallthrough", "return"))) or (kind == "op" and text in (")", "]", "}", "++", "--"))
            if ends:
                self.tokens.append(("op", ";", b, b, False))

    def end(self) -> None:
        if not self.skip(";") and self.at < len(self.tokens) and not self.is_("}", ")"):
            raise _Wrong

    # types

    def type_(self) -> Node:
        a = self.start
        if self.is_("*"):
            self.take()
            return self.node("pointer_type", a, (None, self.type_()))
        if self.is_("("):
            self.take()
            n = self.type_()
            self.take(")")
            return self.node("parenthesized_type", a, (None, n))
        if self.is_("["):
            if self.ahead() == "]":
                self.at += 2
                return self.node("slice_type", a, ("element", self.type_()))
            self.take()
            size = None if self.skip("...") else self.expression()
            self.take("]")
            return self.node("array_type", a, ("length", size), ("element", self.type_()))
        if self.is_("map"):
            self.take()
            self.take("[")
            key = self.type_()
            self.take("]")
            return self.node("map_type", a, ("key", key), ("value", self.type_()))
        if self.is_("chan", "<-"):
            self.skip("<-")
            self.take("chan")
            self.skip("<-")
            return self.node("channel_type", a, ("value", self.type_()))
        if self.is_("func"):
            self.take()
            parameters = self.parameters()
            return self.node("function_type", a, ("parameters", parameters), ("result", self.result()))
        if self.is_("struct"):
            self.take()
            b = self.start
            fields = self.block("field_declaration_list", self.field)
            fields.start = b
            return self.node("struct_type", a, (None, fields))
        if self.is_("interface"):
            self.take()
            return self.node("interface_type", a, *self.block("", self.element).children)
        n = self.name("type_identifier")
        if self.is_(".") and self.ahead_kind() == "id":
            self.take()
            n.type = "package_identifier"
            n = self.node("qualified_type", a, ("package", n), ("name", self.name("type_identifier")))
        if self.is_("[") and self.ahead() != "]":
            back = self.at
            try:
                n = self.node("generic_type", a, ("type", n), ("type_arguments", self.listed("type_arguments", self.type_)))
            except _Wrong:
                self.at = back
        return n

    def field(self) -> Node | None:
        if self.skip(";"):
            return None
        a, kids = self.start, []
        if self.kind == "id" and (self.ahead_kind() in ("id",) or self.ahead() in (",", "*", "[", "(", "<-")):
            kids.append(("name", self.name("field_identifier")))
            while self.skip(","):
                kids.append(("name", self.name("field_identifier")))
        kids.append(("type", self.type_()))
        if self.kind in ("str", "raw"):
            kids.append(("tag", self.primary()))
        n = self.node("field_declaration", a, *kids)
        self.end()
        return n

    def element(self) -> Node | None:
        if self.skip(";"):
            return None
        a = self.start
        if self.kind == "id" and self.ahead() == "(":
            name, parameters = self.name("field_identifier"), self.parameters()
            n = self.node("method_elem", a, ("name", name), ("parameters", parameters), ("result", self.result()))
        else:
            n = self.balanced("type_elem", lambda: False)
        self.end()
        return n

    def parameters(self) -> Node:
        """Names with types, or types only."""
        back = self.at

        def named() -> Node:
            a = self.start
            names = [("name", self.name())]
            while self.is_(",") and self.ahead_kind() == "id" and self.ahead(2) not in (".",):
                self.take()
                names.append(("name", self.name()))
            spread = self.skip("...")
            kind = self.type_()
            return self.node("variadic_parameter_declaration" if spread else "parameter_declaration", a, *names, ("type", kind))

        def plain() -> Node:
            a = self.start
            spread = self.skip("...")
            return self.node("variadic_parameter_declaration" if spread else "parameter_declaration", a, ("type", self.type_()))

        try:
            return self.listed("parameter_list", named)
        except _Wrong:
            self.at = back
            return self.listed("parameter_list", plain)

    def result(self) -> Node | None:
        if self.is_("("):
            return self.parameters()
        if self.kind == "id" and (self.text not in self.keywords or self.is_("map", "chan", "func", "struct", "interface")) or self.is_("*", "[", "<-"):
            return self.type_()
        return None

    # expressions

    def several(self) -> Node:
        a, kids = self.start, [(None, self.expression())]
        while self.skip(","):
            kids.append((None, self.expression()))
        return self.node("expression_list", a, *kids)

    def argument(self) -> Node:
        a = self.start
        if self.is_("[", "map", "chan", "struct", "interface"):
            back = self.at
            n = self.type_()
            if not self.is_("{", "("):
                return n
            self.at = back
        n = self.expression()
        if self.is_("..."):
            self.take()
            n = self.node("variadic_argument", a, (None, n))
        return n

    def arguments(self) -> Node:
        kept, self.bare = self.bare, False
        n = self.listed("argument_list", self.argument)
        self.bare = kept
        return n

    def inner(self) -> Node:
        kept, self.bare = self.bare, False
        n = super().inner()
        self.bare = kept
        return n

    def literal(self, a: int, kind: Node) -> Node:
        kept, self.bare = self.bare, False
        value = self.literal_value()
        self.bare = kept
        return self.node("composite_literal", a, ("type", kind), ("body", value))

    def literal_value(self) -> Node:
        def part() -> Node:
            b = self.start
            n = self.literal_value() if self.is_("{") else self.expression()
            return Node("literal_element", b, self.behind, [(None, n)])

        def one() -> Node:
            b, first = self.start, part()
            if self.skip(":"):
                return self.node("keyed_element", b, ("key", first), ("value", part()))
            return first

        return self.listed("literal_value", one)

    def primary(self) -> Node:
        a, kind, text = self.start, self.kind, self.text
        if kind == "num":
            return self.leaf("imaginary_literal" if text[-1] == "i" else "float_literal" if ("." in text or "e" in text.lower()) and text[:2].lower() != "0x" else "int_literal")
        if kind == "raw":
            return self.leaf("raw_string_literal")
        if kind == "str":
            if text[0] == "'":
                return self.leaf("rune_literal")
            n = self.leaf("interpreted_string_literal")
            if n.end - n.start > 2:
                n.children.append((None, Node("interpreted_string_literal_content", n.start + 1, n.end - 1)))
            return n
        if text == "(":
            return self.inner()
        if text == "func":
            self.take()
            parameters = self.parameters()
            result = self.result()
            kept, self.bare = self.bare, False
            body = self.block()
            self.bare = kept
            return self.node("func_literal", a, ("parameters", parameters), ("result", result), ("body", body))
        if text in ("[", "map", "struct", "chan", "interface"):
            made = self.type_()
            return self.literal(a, made) if self.is_("{") else made
        if kind != "id" or text in self.keywords:
            raise _Wrong
        if text in ("nil", "true", "false", "iota"):
            return self.leaf(text)
        return self.leaf("identifier")

    def postfix(self, n: Node) -> Node:
        while self.at < len(self.tokens):
            if self.is_("."):
                self.take()
                if self.skip("("):
                    kind = self.leaf("type") if self.is_("type") else self.type_()
                    self.take(")")
                    n = self.node("type_assertion_expression", n.start, ("operand", n), ("type", kind))
                else:
                    n = self.node("selector_expression", n.start, ("operand", n), ("field", self.name("field_identifier")))
            elif self.is_("("):
                n = self.node("call_expression", n.start, ("function", n), ("arguments", self.arguments()))
            elif self.is_("["):
                n = self.index(n)
            elif self.is_("{") and not self.bare and n.type in ("identifier", "selector_expression", "index_expression"):
                kind = Node("type_identifier" if n.type == "identifier" else "qualified_type" if n.type == "selector_expression" else "generic_type", n.start, n.end, n.children)
                n = self.literal(n.start, kind)
            else:
                break
        return n

    def index(self, n: Node) -> Node:
        self.take("[")
        kept, self.bare = self.bare, False
        names = iter(("start", "end", "capacity"))
        parts: list[tuple[str | None, Node | None]] = []
        sliced = False
        while not self.is_("]"):
            label = next(names, None)
            if not self.is_(":"):
                parts.append((label, self.argument()))
            if self.skip(":"):
                sliced = True
            elif self.skip(","):
                continue
            elif not self.is_("]"):
                raise _Wrong
        self.take("]")
        self.bare = kept
        if sliced:
            return self.node("slice_expression", n.start, ("operand", n), *parts)
        if not parts:
            raise _Wrong
        return self.node("index_expression", n.start, ("operand", n), ("index", parts[0][1]), *((None, p) for _, p in parts[1:]))

    # statements

    def simple(self) -> Node:
        a = self.start
        if self.is_("range"):
            return self.ranged(a, None)
        left = self.several()
        if self.is_("++", "--"):
            word = self.take()[1]
            return self.node("inc_statement" if word == "++" else "dec_statement", a, *left.children)
        if self.is_("<-"):
            self.take()
            return self.node("send_statement", a, ("channel", left.children[0][1]), ("value", self.expression()))
        if self.is_(":=") or (self.kind == "op" and self.text in _ASSIGN):
            op = self.sign()
            if self.is_("range"):
                return self.ranged(a, left)
            right = self.several()
            if op.type == ":=":
                return self.node("short_var_declaration", a, ("left", left), ("right", right))
            return self.node("assignment_statement", a, ("left", left), ("operator", op), ("right", right))
        if len(left.children) > 1:
            raise _Wrong
        return self.node("expression_statement", a, *left.children)

    def ranged(self, a: int, left: Node | None) -> Node:
        self.take("range")
        return self.node("range_clause", a, ("left", left), ("right", self.expression()))

    def grouped(self, type_: str, one: Callable[[], Node]) -> Node:
        """word spec, or word ( specs )"""
        a = self.start
        self.take()
        if not self.is_("("):
            n = self.node(type_, a, (None, one()))
        else:
            end = self.closing()
            self.take()
            kids = []
            while self.at < end:
                if self.skip(";"):
                    continue
                b, before = self.start, self.at
                try:
                    kids.append((None, one()))
                except _Wrong:
                    kids.append((None, self.error(b, before)))
                self.at = max(self.at, before + 1)
            self.at = end + 1
            n = self.node(type_, a, *kids)
        self.end()
        return n

    def spec(self, type_: str) -> Callable[[], Node]:
        def one() -> Node:
            a = self.start
            names = [("name", self.name())]
            while self.skip(","):
                names.append(("name", self.name()))
            kind = None if self.is_("=", ";", ")") or self.at >= len(self.tokens) else self.type_()
            value = self.several() if self.skip("=") else None
            return self.node(type_, a, *names, ("type", kind), ("value", value))

        return one

    def type_spec(self) -> Node:
        a = self.start
        name = self.name("type_identifier")
        kids: list[tuple[str | None, Node | None]] = [("name", name)]
        if self.is_("[") and self.ahead_kind() == "id" and self.ahead(2) != "]":
            kids.append(("type_parameters", self.parameters_of_type()))
        alias = self.skip("=")
        kids.append(("type", self.type_()))
        return self.node("type_alias" if alias else "type_spec", a, *kids)

    def parameters_of_type(self) -> Node:
        a = self.start
        self.at = self.closing() + 1
        return self.node("type_parameter_list", a)

    def import_spec(self) -> Node:
        a = self.start
        name = None
        if self.kind == "id":
            name = self.name("package_identifier")
        elif self.is_("."):
            name = self.leaf("dot")
        if self.kind not in ("str", "raw"):
            raise _Wrong
        return self.node("import_spec", a, ("name", name), ("path", self.primary()))

    def head(self) -> list[tuple[str | None, Node]]:
        """initializer; condition of if and switch"""
        kept, self.bare = self.bare, True
        kids: list[tuple[str | None, Node]] = []
        try:
            first = None if self.is_(";", "{") else self.simple()
            if self.skip(";"):
                if first is not None:
                    kids.append(("initializer", first))
                first = None if self.is_("{") else self.simple()
            if first is not None:
                kids.append(("condition", first.children[0][1] if first.type == "expression_statement" else first))
        finally:
            self.bare = kept
        return kids

    def if_(self) -> Node:
        a = self.start
        self.take("if")
        head, yes = self.head(), self.block()
        other = None
        if self.skip("else"):
            other = self.if_() if self.is_("if") else self.block()
        return self.node("if_statement", a, *head, ("consequence", yes), ("alternative", other))

    def for_(self) -> Node:
        a = self.start
        self.take("for")
        kept, self.bare = self.bare, True
        clause = None
        try:
            b = self.start
            first = None if self.is_("{", ";") else self.simple()
            if self.is_(";"):
                self.take()
                test = None if self.is_(";", "{") else self.expression()
                self.skip(";")
                more = None if self.is_("{") else self.simple()
                clause = self.node("for_clause", b, ("initializer", first), ("condition", test), ("update", more))
            elif first is not None:
                clause = first.children[0][1] if first.type == "expression_statement" else first
        finally:
            self.bare = kept
        return self.node("for_statement", a, (None, clause), ("body", self.block()))

    def cases(self, type_: str) -> Node:
        a = self.start
        word = self.take()[1]
        head = self.head() if word == "switch" else []
        kind = type_

        def one() -> Node | None:
            if self.skip(";"):
                return None
            b = self.start
            if self.skip("default"):
                self.take(":")
                return self.node("default_case", b, *self.statements(lambda: self.is_("case", "default", "}")))
            self.take("case")
            if word == "select":
                value: Node = self.simple()
            else:
                c, kids = self.start, [(None, self.argument())]
                while self.skip(","):
                    kids.append((None, self.argument()))
                value = self.node("expression_list", c, *kids)
            self.take(":")
            return self.node("communication_case" if word == "select" else "expression_case", b, ("communication" if word == "select" else "value", value), *self.statements(lambda: self.is_("case", "default", "}")))

        body = self.block("", one)
        if word == "switch" and any(".(type)" in self.source[n.start : n.end].replace(" ", "") for _, n in head):
            kind = "type_switch_statement"
        return self.node(kind, a, *(("value" if f == "condition" else f, n) for f, n in head), *body.children)

    def statement(self) -> Node | None:
        self.bare = False
        a, text = self.start, self.text if self.kind in ("id", "op") else ""
        if text == ";":
            self.take()
            return None
        if text == "package":
            self.take()
            n = self.node("package_clause", a, (None, self.name("package_identifier")))
            self.end()
            return n
        if text == "import":
            return self.grouped("import_declaration", self.import_spec)
        if text == "var":
            return self.grouped("var_declaration", self.spec("var_spec"))
        if text == "const":
            return self.grouped("const_declaration", self.spec("const_spec"))
        if text == "type":
            return self.grouped("type_declaration", self.type_spec)
        if text == "func" and (self.ahead_kind() == "id" or self.ahead() == "(") and (method := self.function()):
            return method
        if text == "{":
            n = self.block()
        elif text == "if":
            n = self.if_()
        elif text == "for":
            n = self.for_()
        elif text == "switch":
            n = self.cases("expression_switch_statement")
        elif text == "select":
            n = self.cases("select_statement")
        elif text in ("go", "defer"):
            self.take()
            n = self.node(f"{text}_statement", a, (None, self.expression()))
        elif text == "return":
            self.take()
            n = self.node("return_statement", a, (None, None if self.is_(";", "}") else self.several()))
        elif text in ("break", "continue", "goto", "fallthrough"):
            self.take()
            n = self.node(f"{text}_statement", a, (None, self.name("label_name") if self.kind == "id" else None))
        elif self.kind == "id" and self.ahead() == ":" and text not in self.keywords:
            label = self.name("label_name")
            self.take(":")
            return self.node("labeled_statement", a, ("label", label), (None, None if self.is_("}") else self.statement()))
        else:
            n = self.simple()
        self.end()
        return n

    def function(self) -> Node | None:
        a, back = self.start, self.at
        self.take("func")
        receiver = None
        if self.is_("("):
            behind = self.closing() + 1
            if behind >= len(self.tokens) or self.tokens[behind][0] != "id" or behind + 1 >= len(self.tokens) or self.tokens[behind + 1][1] != "(":
                self.at = back
                return None
            receiver = self.parameters()
        name = self.name("field_identifier" if receiver else "identifier")
        kinds = self.parameters_of_type() if self.is_("[") else None
        parameters = self.parameters()
        result = self.result()
        body = self.block() if self.is_("{") else None
        n = self.node("method_declaration" if receiver else "function_declaration", a, ("receiver", receiver), ("name", name), ("type_parameters", kinds), ("parameters", parameters), ("result", result), ("body", body))
        self.end()
        return n


# --- Rust

class Rust(Reader):
    comment = ("line_comment", "block_comment")
    levels = {**dict.fromkeys(("..", "..="), 1), "||": 3, "&&": 4, **dict.fromkeys("== != < > <= >=".split(), 5), "|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11}
    block_type, root, operand = "block", "source_file", None
    unary = frozenset("! - *".split())
    keywords = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
    _named = {"self", "super", "crate"}
    bare = False  # whether a brace opens a block rather than a struct's fields
    _items = frozenset("fn struct enum union impl trait mod use const static type extern unsafe async pub macro_rules".split())
    _raw = re.compile(r'(?:b|c)?r(#*)".*?"\1', re.S)
    _text = re.compile(r'[bc]?"(?:\\.|[^"\\])*(?:"|\Z)', re.S)
    _char = re.compile(r"b?'(?:\\(?:x[\da-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n])'")
    _life = re.compile(r"'[^\W\d]\w*")
    _number = re.compile(r"0[xob][\da-fA-F_]+(?:[iu]\w+)?|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?(?:[iuf]\w+)?")
    _place = re.compile(r"\d+")
    _edges = re.compile(r"/\*|\*/")

    def special(self, at: int) -> tuple[str, int] | None:
        c = self.source[at]
        if c in "rbc\"":
            for kind, p in (("raw", self._raw), ("str", self._text)):
                if m := p.match(self.source, at):
                    return kind, m.end()
        if c in "b'":
            if m := self._char.match(self.source, at):
                return "char", m.end()
            if m := self._life.match(self.source, at):
                return "life", m.end()
        if c.isdigit():
            return "num", (self._place if self.tokens and self.tokens[-1][1] == "." else self._number).match(self.source, at).end()
        for sign in ("..=", "...", ".."):
            if self.source.startswith(sign, at):
                return "op", at + len(sign)
        if c in "#?.*" and not self.source.startswith("*=", at):  # no signs of more than one
            return "op", at + 1
        if self.source.startswith("/*", at):  # these nest
            depth, i = 1, at + 2
            for m in self._edges.finditer(self.source, i):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    return "comment", m.end()
            return "comment", len(self.source)
        return None

    # types and patterns, as names in brackets

    def type_(self, *more: str) -> Node:
        stops = ("=", ";", ",", "{", ")", "]", "}", "where", "=>", ">", ">>", "|", *more)
        return self.balanced("type", lambda: self.is_(*stops))

    def balanced(self, type_: str, stops: Callable[[], bool]) -> Node:
        a, kids, depth = self.start, [], 0
        while self.at < len(self.tokens) and (depth > 0 or not stops()):
            if self.is_("<"):
                depth += 1
            elif self.is_(">", ">>") and depth:
                depth -= len(self.text)
            elif self.kind == "op" and self.text in _OPEN:
                if self.text == "{" and depth <= 0:
                    break
                self.at = self.closing()
            elif self.kind == "op" and self.text in (*_CLOSE, ";"):
                break
            if self.kind == "id" and self.text not in self.keywords:
                kids.append((None, Node("type_identifier", self.start, self.tokens[self.at][3])))
            self.at += 1
        if self.at == 0 or self.behind <= a:
            raise _Wrong
        if len(kids) == 1 and kids[0][1].start == a and kids[0][1].end == self.behind:
            return kids[0][1]
        return self.node(type_, a, *kids)

    def pattern(self, *stops: str) -> Node:
        if self.kind == "id" and self.text not in self.keywords and self.ahead() in stops:
            return self.leaf("identifier")
        a, kids = self.start, []
        while self.at < len(self.tokens) and not self.is_(*stops):
            if self.kind == "op" and self.text in _OPEN:
                end = self.closing()
                while self.at < end:
                    self.at += 1
                    if self.kind == "id" and self.text not in self.keywords:
                        kids.append((None, Node("identifier", self.start, self.tokens[self.at][3])))
            elif self.kind == "op" and self.text in (*_CLOSE, ";"):
                break
            elif self.kind == "id" and self.text not in self.keywords:
                kids.append((None, Node("identifier", self.start, self.tokens[self.at][3])))
            self.at += 1
        if self.behind <= a:
            raise _Wrong
        return self.node("pattern", a, *kids)

    def generics(self, type_: str) -> Node:
        a, depth, kids = self.start, 0, []
        while True:
            if self.is_("<"):
                depth += 1
            elif self.is_(">", ">>"):
                depth -= len(self.text)
            elif self.kind == "op" and self.text in _OPEN:
                self.at = self.closing()
            elif self.is_(";") or (self.kind == "op" and self.text in _CLOSE):
                raise _Wrong
            elif self.kind == "id" and self.text not in self.keywords:
                kids.append((None, Node("type_identifier", self.start, self.tokens[self.at][3])))
            self.take()
            if depth <= 0:
                return self.node(type_, a, *kids)

    # expressions

    def whole(self) -> Node:
        a = self.start
        left = self.expression()
        if self.kind == "op" and self.text in _ASSIGN:
            op = self.sign()
            if op.type == "=":
                return self.node("assignment_expression", a, ("left", left), ("right", self.whole()))
            return self.node("compound_assignment_expr", a, ("left", left), ("operator", op), ("right", self.whole()))
        return left

    def expression(self, level: int = 0) -> Node:
        a = self.start
        if self.is_("..", "..="):
            self.take()
            return self.node("range_expression", a, (None, None if self.ends() else self.expression(1)))
        left = self.prefix()
        while self.at < len(self.tokens):
            if self.is_("as"):
                self.take()
                left = self.node("type_cast_expression", a, ("value", left), ("type", self.cast_type()))
                continue
            own = self.levels.get(self.text) if self.kind == "op" else None
            if own is None or own <= level:
                break
            op = self.sign()
            if own == 1:
                left = self.node("range_expression", a, (None, left), (None, None if self.ends() else self.expression(1)))
            else:
                left = self.node("binary_expression", a, ("left", left), ("operator", op), ("right", self.expression(own)))
        return left

    def ends(self) -> bool:
        return self.at >= len(self.tokens) or self.is_(")", "]", "}", ",", ";", "=>") or (self.bare and self.is_("{"))

    def cast_type(self) -> Node:
        a = self.start
        while self.is_("&", "*", "mut", "const", "dyn") or self.kind == "life":
            self.take()
        if self.is_("(", "["):
            self.at = self.closing() + 1
        else:
            self.take()
            while self.is_("::") and self.ahead_kind() == "id":
                self.at += 2
            if self.is_("<"):
                self.generics("type_arguments")
        n = self.node("type", a)
        if n.end - n.start and re.fullmatch(r"\w+", self.source[n.start : n.end]):
            basic = re.fullmatch(r"[iu](?:8|16|32|64|128|size)|f32|f64|bool|char|str", self.source[n.start : n.end])
            n.type = "primitive_type" if basic else "type_identifier"
        return n

    def prefix(self) -> Node:
        a = self.start
        if self.is_("&", "&&"):
            self.take()
            self.skip("mut")
            return self.node("reference_expression", a, ("value", self.prefix()))
        return super().prefix()

    def unbared(self, one: Callable[[], Node]) -> Node:
        kept, self.bare = self.bare, False
        n = one()
        self.bare = kept
        return n

    def arguments(self) -> Node:
        return self.unbared(lambda: self.listed("arguments", self.argument))

    def argument(self) -> Node:
        while self.is_("#"):
            self.attribute()
        return self.whole()

    def attribute(self) -> Node:
        a = self.start
        self.take("#")
        inner = self.skip("!")
        if not self.is_("["):
            raise _Wrong
        b, end = self.tokens[self.at + 1][2] if self.at + 1 < len(self.tokens) else self.start, self.closing()
        kids = [(None, Node("identifier", t[2], t[3])) for t in self.tokens[self.at + 1 : end] if t[0] == "id"]
        last = self.tokens[end][2]
        self.at = end + 1
        return self.node("inner_attribute_item" if inner else "attribute_item", a, (None, Node("attribute", b, last, kids)))

    def trees(self) -> Node:
        """A macro's tokens."""
        a, end = self.start, self.closing()
        kids: list[tuple[str | None, Node]] = []
        self.at += 1
        while self.at < end:
            if self.kind == "op" and self.text in _OPEN and self.at in self.match:
                kids.append((None, self.trees()))
                continue
            if self.kind != "op":
                kids.append((None, self.token()))
            else:
                self.at += 1
        self.at = end + 1
        return self.node("token_tree", a, *kids)

    def token(self) -> Node:
        kind, text = self.kind, self.text
        if kind == "num":
            return self.leaf("float_literal" if re.search(r"\.|[^xXa-fA-F\d_][eE]|f(?:32|64)$", text) and text[:2] != "0x" else "integer_literal")
        if kind == "raw":
            return self.leaf("raw_string_literal")
        if kind == "str":
            n = self.leaf("string_literal")
            first = self.source.index('"', n.start) + 1
            if n.end - first > 1:
                n.children.append((None, Node("string_content", first, n.end - 1)))
            return n
        if kind == "char":
            return self.leaf("char_literal")
        if kind == "life":
            return self.leaf("lifetime")
        if text in ("true", "false"):
            return self.leaf("boolean_literal")
        return self.leaf(text if text in self._named else "identifier")

    def path(self) -> Node:
        """a::b::<T>::c"""
        a = self.start
        n: Node | None = None
        if self.is_("<"):
            n = self.generics("bracketed_type")
        elif not self.is_("::"):
            n = self.token()
        while self.is_("::"):
            self.take()
            if self.is_("<"):
                n = self.node("generic_function", a, ("function", n), ("type_arguments", self.generics("type_arguments")))
                continue
            if self.kind != "id":
                raise _Wrong
            n = self.node("scoped_identifier", a, ("path", n), ("name", self.leaf("identifier")))
        if n is None:
            raise _Wrong
        return n

    def primary(self) -> Node:
        a, kind, text = self.start, self.kind, self.text
        if kind in ("num", "str", "raw", "char"):
            return self.token()
        if kind == "life" and self.ahead() == ":":
            label = self.leaf("label")
            self.take(":")
            n = self.primary()
            n.start = a
            n.children.insert(0, (None, label))
            return n
        if text in ("true", "false"):
            return self.token()
        if text == "(":
            return self.unbared(self.tuple)
        if text == "[":
            return self.unbared(lambda: self.listed("array_expression", self.element))
        if text == "{":
            return self.unbared(self.block)
        if text in ("|", "||") or (text in ("move", "async") and self.ahead() in ("|", "||", "move")):
            return self.closure()
        if text in ("unsafe", "async", "const") and self.ahead() in ("{", "move"):
            self.take()
            self.skip("move")
            return self.node(f"{text}_block", a, (None, self.unbared(self.block)))
        if text == "if":
            return self.if_()
        if text == "match":
            self.take()
            value = self.head()
            return self.node("match_expression", a, ("value", value), ("body", self.unbared(lambda: self.block("match_block", self.arm))))
        if text == "while":
            self.take()
            test = self.condition()
            return self.node("while_expression", a, ("condition", test), ("body", self.unbared(self.block)))
        if text == "loop":
            self.take()
            return self.node("loop_expression", a, ("body", self.unbared(self.block)))
        if text == "for":
            self.take()
            name = self.pattern("in")
            self.take("in")
            value = self.head()
            return self.node("for_expression", a, ("pattern", name), ("value", value), ("body", self.unbared(self.block)))
        if text in ("return", "break", "continue"):
            self.take()
            label = self.leaf("label") if self.kind == "life" else None
            value = None if self.ends() or text == "continue" else self.whole()
            return self.node(f"{text}_expression", a, (None, label), (None, value))
        if kind == "id" and text in self.keywords and text not in (*self._named, "Self") or (kind != "id" and not self.is_("<", "::")):
            raise _Wrong
        n = self.path()
        if self.is_("!") and self.ahead() in ("(", "[", "{") and n.type in ("identifier", "scoped_identifier"):
            self.take()
            return self.node("macro_invocation", a, ("macro", n), (None, self.trees()))
        if self.is_("{") and not self.bare and n.type in ("identifier", "scoped_identifier", "generic_function") and re.search(r"(?:^|::)\s*[A-Z]\w*\s*(?:::\s*<.*)?$", self.source[n.start : n.end], re.S):
            n.type = {"identifier": "type_identifier", "scoped_identifier": "scoped_type_identifier"}.get(n.type, "generic_type_with_turbofish")
            return self.node("struct_expression", a, ("name", n), ("body", self.listed("field_initializer_list", self.initialised)))
        return n

    def initialised(self) -> Node:
        a = self.start
        while self.is_("#"):
            self.attribute()
        if self.skip(".."):
            return self.node("base_field_initializer", a, (None, self.whole()))
        if self.ahead() != ":":
            return self.node("shorthand_field_initializer", a, (None, self.token()))
        name = self.leaf("field_identifier")
        self.take(":")
        return self.node("field_initializer", a, ("field", name), ("value", self.whole()))

    def element(self) -> Node:
        n = self.whole()
        if self.skip(";"):
            length = self.whole()
            return Node("", n.start, self.behind, [(None, n), ("length", length)])
        return n

    def tuple(self) -> Node:
        a, end = self.start, self.closing()
        n = self.listed("tuple_expression", self.argument)
        if not n.children:
            n.type = "unit_expression"
        elif len(n.children) == 1 and self.tokens[end - 1][1] != ",":
            n.type = "parenthesized_expression"
        n.start = a
        return n

    def closure(self) -> Node:
        a = self.start
        self.skip("async")
        self.skip("move")
        b = self.start
        kids: list[tuple[str | None, Node]] = []
        if not self.skip("||"):
            self.take("|")
            while not self.is_("|"):
                kids.append((None, self.pattern("|", ",", ":")))
                if self.skip(":"):
                    self.type_()
                if not self.skip(",") and not self.is_("|"):
                    raise _Wrong
            self.take("|")
        parameters = self.node("closure_parameters", b, *kids)
        result = self.type_() if self.skip("->") else None
        return self.node("closure_expression", a, ("parameters", parameters), ("return_type", result), ("body", self.block() if self.is_("{") else self.whole()))

    def head(self) -> Node:
        kept, self.bare = self.bare, True
        n = self.whole()
        self.bare = kept
        return n

    def condition(self) -> Node:
        a, kids = self.start, []
        while True:
            b = self.start
            if self.skip("let"):
                name = self.pattern("=")
                self.take("=")
                kept, self.bare = self.bare, True
                value = self.expression(4)
                self.bare = kept
                kids.append((None, self.node("let_condition", b, ("pattern", name), ("value", value))))
            else:
                kept, self.bare = self.bare, True
                kids.append((None, self.expression(4) if kids else self.until_let()))
                self.bare = kept
            if not self.skip("&&"):
                break
        return kids[0][1] if len(kids) == 1 else self.node("let_chain", a, *kids)

    def until_let(self) -> Node:
        back = self.at
        n = self.expression(4)
        if self.is_("&&") and self.ahead() == "let":
            return n
        self.at = back
        return self.whole()

    def if_(self) -> Node:
        a = self.start
        self.take("if")
        test = self.condition()
        yes, other = self.unbared(self.block), None
        if self.is_("else"):
            b = self.start
            self.take()
            other = self.node("else_clause", b, (None, self.if_() if self.is_("if") else self.unbared(self.block)))
        return self.node("if_expression", a, ("condition", test), ("consequence", yes), ("alternative", other))

    def arm(self) -> Node | None:
        if self.skip(","):
            return None
        a = self.start
        while self.is_("#"):
            self.attribute()
        b = self.start
        name = self.pattern("=>", "if")
        test = None
        if self.skip("if"):
            test = self.condition()
        shown = self.node("match_pattern", b, (None, name), ("condition", test))
        self.take("=>")
        n = self.node("match_arm", a, ("pattern", shown), ("value", self.whole()))
        if not self.skip(",") and not self.is_("}") and self.tokens[self.at - 1][1] != "}":
            raise _Wrong
        return n

    def postfix(self, n: Node) -> Node:
        while self.at < len(self.tokens):
            if self.is_("?"):
                self.take()
                n = self.node("try_expression", n.start, (None, n))
            elif self.is_("."):
                self.take()
                if self.skip("await"):
                    n = self.node("await_expression", n.start, (None, n))
                    continue
                if self.kind not in ("id", "num"):
                    raise _Wrong
                n = self.node("field_expression", n.start, ("value", n), ("field", self.leaf("field_identifier" if self.kind == "id" else "integer_literal")))
                if self.is_("::"):
                    self.take()
                    n = self.node("generic_function", n.start, ("function", n), ("type_arguments", self.generics("type_arguments")))
            elif self.is_("("):
                n = self.node("call_expression", n.start, ("function", n), ("arguments", self.arguments()))
            elif self.is_("["):
                self.take()
                index = self.unbared(self.whole)
                self.take("]")
                n = self.node("index_expression", n.start, (None, n), (None, index))
            else:
                break
        return n

    # items and statements

    _blocks = frozenset("if match while loop for unsafe { async".split())

    def statement(self) -> Node | None:
        self.bare = False
        a, text = self.start, self.text if self.kind in ("id", "op") else ""
        if text == ";":
            self.take()
            return None
        if text == "#":
            return self.attribute()
        if text == "let":
            self.take()
            name = self.pattern("=", ":", ";")
            kind = self.type_() if self.skip(":") else None
            value = self.whole() if self.skip("=") else None
            other = self.block() if self.skip("else") else None
            self.take(";")
            return self.node("let_declaration", a, ("pattern", name), ("type", kind), ("value", value), ("alternative", other))
        if text in self._items and not (text in ("unsafe", "async", "const") and self.ahead() in ("{", "move", "|", "||")) and not (text in ("union", "macro_rules") and self.ahead_kind() != "id" and self.ahead() != "!"):
            return self.item()
        blocks = text in self._blocks or (self.kind == "life" and self.ahead() == ":")
        if blocks:
            n = self.primary()
            if self.is_(".", "?"):
                n = self.postfix(n)
                blocks = False
            if blocks:
                self.skip(";")
                return self.node("expression_statement", a, (None, n))
        else:
            n = self.whole()
        if self.skip(";") or (n.type == "macro_invocation" and self.tokens[self.at - 1][1] == "}"):
            return self.node("expression_statement", a, (None, n))
        if self.at < len(self.tokens) and not self.is_("}"):
            raise _Wrong
        return n

    def item(self) -> Node:
        a = self.start
        seen = None
        if self.is_("pub"):
            b = self.start
            self.take()
            if self.is_("("):
                self.at = self.closing() + 1
            seen = self.node("visibility_modifier", b)
        marks = []
        while (self.is_("unsafe", "async", "default") or (self.is_("const") and self.ahead() in ("fn", "unsafe", "extern", "async")) or (self.is_("extern") and self.ahead_kind() in ("str", "id") and self.ahead() != "crate")) and self.ahead() != "{":
            if self.take()[1] == "extern" and self.kind == "str":
                self.take()
            marks.append(1)
            if self.is_("{"):
                return self.node("foreign_mod_item", a, ("body", self.block("declaration_list")))
        if self.at >= len(self.tokens) or self.kind != "id":
            raise _Wrong
        word = self.take()[1]
        kids: list[tuple[str | None, Node | None]] = [(None, seen)]
        if word == "fn":
            kids.append(("name", self.name()))
            if self.is_("<"):
                kids.append(("type_parameters", self.generics("type_parameters")))
            kids.append(("parameters", self.listed("parameters", self.parameter)))
            if self.skip("->"):
                kids.append(("return_type", self.type_()))
            self.where()
            if self.skip(";"):
                return self.node("function_signature_item", a, *kids)
            return self.node("function_item", a, *kids, ("body", self.block()))
        if word in ("struct", "union", "enum", "trait", "type"):
            kids.append(("name", self.name("type_identifier")))
            if self.is_("<"):
                kids.append(("type_parameters", self.generics("type_parameters")))
            if word == "type":
                if self.skip(":"):
                    self.type_()
                self.where()
                kind = self.type_() if self.skip("=") else None
                self.take(";")
                return self.node("type_item" if kind else "associated_type", a, *kids, ("type", kind))
            if self.skip(":"):
                kids.append(("bounds", self.type_()))
            self.where()
            if word == "trait":
                return self.node("trait_item", a, *kids, ("body", self.block("declaration_list")))
            if self.is_("("):
                kids.append(("body", self.listed("ordered_field_declaration_list", self.ordered)))
                self.where()
            if self.is_("{"):
                kids.append(("body", self.listed("enum_variant_list", self.variant) if word == "enum" else self.listed("field_declaration_list", self.field)))
            else:
                self.take(";")
            return self.node(f"{word}_item", a, *kids)
        if word == "impl":
            if self.is_("<"):
                kids.append(("type_parameters", self.generics("type_parameters")))
            kind = self.type_("for")
            if self.skip("for"):
                kids.append(("trait", kind))
                kind = self.type_()
            kids.append(("type", kind))
            self.where()
            return self.node("impl_item", a, *kids, ("body", self.block("declaration_list")))
        if word == "mod":
            kids.append(("name", self.name()))
            if not self.skip(";"):
                kids.append(("body", self.block("declaration_list")))
            return self.node("mod_item", a, *kids)
        if word == "use":
            b = self.start
            while not self.is_(";"):
                if self.kind == "op" and self.text in _OPEN:
                    self.at = self.closing()
                self.take()
            kids.append(("argument", self.node("use_path", b)))
            self.take(";")
            return self.node("use_declaration", a, *kids)
        if word in ("const", "static"):
            self.skip("mut")
            kids.append(("name", self.name()))
            self.take(":")
            kids.append(("type", self.type_()))
            if self.skip("="):
                kids.append(("value", self.whole()))
            self.take(";")
            return self.node(f"{word}_item", a, *kids)
        if word == "extern" and self.is_("crate"):
            while not self.is_(";"):
                self.take()
            self.take(";")
            return self.node("extern_crate_declaration", a)
        if word == "macro_rules":
            self.take("!")
            kids.append(("name", self.name()))
            kids += self.trees().children
            self.skip(";")
            return self.node("macro_definition", a, *kids)
        raise _Wrong

    def where(self) -> None:
        while self.at < len(self.tokens) and self.is_("where") or (self.tokens[self.at - 1][1] == "," and not self.is_("{", ";")):
            self.take()
            self.balanced("where_clause", lambda: self.is_("{", ";", ","))
            self.skip(",")

    def parameter(self) -> Node:
        a = self.start
        while self.is_("#"):
            self.attribute()
        back = self.at
        while self.is_("&", "mut") or self.kind == "life":
            self.take()
        if self.is_("self"):
            self.take()
            if self.skip(":"):
                self.type_()
            return self.node("self_parameter", a)
        self.at = back
        if self.is_("..."):
            return self.leaf("variadic_parameter")
        name = self.pattern(":", ",", ")")
        self.take(":")
        return self.node("parameter", a, ("pattern", name), ("type", self.type_()))

    def field(self) -> Node | None:
        a = self.start
        while self.is_("#"):
            self.attribute()
        seen = self.visible()
        name = self.name("field_identifier")
        self.take(":")
        return self.node("field_declaration", a, (None, seen), ("name", name), ("type", self.type_()))

    def visible(self) -> Node | None:
        if not self.is_("pub"):
            return None
        b = self.start
        self.take()
        if self.is_("("):
            self.at = self.closing() + 1
        return self.node("visibility_modifier", b)

    def ordered(self) -> tuple[str, Node]:
        while self.is_("#"):
            self.attribute()
        self.visible()
        return "type", self.type_()

    def variant(self) -> Node:
        while self.is_("#"):
            self.attribute()
        a = self.start
        name, body = self.name(), None
        if self.is_("("):
            body = self.listed("ordered_field_declaration_list", self.ordered)
        elif self.is_("{"):
            body = self.listed("field_declaration_list", self.field)
        value = self.whole() if self.skip("=") else None
        return self.node("enum_variant", a, ("name", name), ("body", body), ("value", value))


READERS: dict[str, type[Reader]] = {"go": Go, "java": Java, "javascript": JavaScript, "rust": Rust, "typescript": TypeScript}


def tree(language: str, source: str) -> Node | None:
    """The tree of a source; None for other languages, and for nesting beyond what can be followed."""
    reader = READERS.get(language)
    if reader is None:
        return None
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)
    try:
        return reader(source).tree()
    except RecursionError:
        return None
