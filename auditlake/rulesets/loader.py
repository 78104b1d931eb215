"""Rules: strict YAML documents, checked and compiled on the driver."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..functions.languages import LANGUAGES
from ..functions.paths import GlobError, glob_regex
from ..model import RANK

ID = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+")
SILO = re.compile(r"[A-Za-z0-9_-]+")
RESERVED = "metrics.duplicate-block"
KINDS = ("regex", "secret", "ast", "boundary", "coverage", "duplication")
SCOPES = ("scan", "file", "silo")
_UNSUPPORTED = re.compile(r"\(\?<?[=!]|\(\?>|\(\?\(|\\[1-9]|\\k<|[*+?}]\+")


class RuleError(ValueError):
    """A rule document that can't be used; the message names the file, the rule and what is wrong."""


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    message: str
    kind: str
    languages: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    pattern: str = ""
    group: int | str = 0
    redact: bool = False
    entropy: float | None = None
    keywords: tuple[str, ...] = ()
    allow_patterns: tuple[str, ...] = ()
    allow_paths: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    queries: tuple[tuple[str, str], ...] = ()
    source: str = ""
    deny: tuple[str, ...] = ()
    limit: float = 0.0
    scope: str = "scan"

    @property
    def redacts(self) -> bool:
        return self.kind == "secret" or (self.kind == "regex" and self.redact)


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    sources: list[tuple[str, str]] = field(default_factory=list)

    def digest(self) -> str:
        """Identity of the rules: SHA-256 over origins and texts, in order."""
        h = hashlib.sha256()
        for origin, text in self.sources:
            for part in (origin, text):
                h.update(len(part.encode()).to_bytes(8, "big") + part.encode())
        return h.hexdigest()

    def of(self, *kinds: str) -> list[Rule]:
        return [r for r in self.rules if r.kind in kinds]

    def redacted(self) -> list[str]:
        return [r.id for r in self.rules if r.redacts]

    def merged(self, other: RuleSet) -> RuleSet:
        known = {r.id for r in self.rules}
        for r in other.rules:
            if r.id in known:
                raise RuleError(f"rule {r.id}: more than one rule has this id")
        return RuleSet(self.rules + other.rules, self.sources + other.sources)


def lint(pattern: str) -> list[str]:
    """Constructs that a linear-time engine doesn't have: look-around, back references, possessive and atomic groups."""
    bare = re.sub(r"\\[\\\[\]]|\[(?:\\.|[^\]])*\]", "x", pattern)
    return sorted(set(_UNSUPPORTED.findall(bare)))


def java_pattern(pattern: str) -> str:
    """For Spark's regular expressions: Unicode classes and case, ``$`` only at the very end, plain group names."""
    return "(?U)" + _ends(pattern.replace("(?P<", "(?<").replace("(?i)", "(?iu)"), r"\\z")


def python_pattern(pattern: str) -> str:
    """For Python's ``regex``: code points in braces spelled out, ``$`` only at the very end."""
    spelled = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)
    return _ends(spelled, r"\\Z")


def _ends(pattern: str, end: str) -> str:
    if re.search(r"\(\?[a-z]*m", pattern):
        return pattern
    return re.sub(r"(\\.)|(\[(?:\\.|[^\]\\])*\])|\$", lambda m: m[0] if m[1] or m[2] else end.replace("\\\\", "\\"), pattern)


def compiled(pattern: str):
    import regex

    return regex.compile(python_pattern(pattern), regex.V0)


def _keys(where: str, data: Any, needed: set[str], optional: set[str]) -> dict:
    if not isinstance(data, dict):
        raise RuleError(f"{where}: a mapping is needed")
    for k in data:
        if k not in needed | optional:
            raise RuleError(f"{where}: unknown key {k!r}")
    for k in sorted(needed):
        if k not in data:
            raise RuleError(f"{where}: {k!r} is missing")
    return data


def _strings(where: str, value: Any) -> tuple[str, ...]:
    if not isinstance(value, list) or any(not isinstance(x, str) for x in value):
        raise RuleError(f"{where}: a list of strings is needed")
    return tuple(value)


def _number(where: str, value: Any, low: float, high: float, open_low: bool = False) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise RuleError(f"{where}: a finite number is needed")
    if value < low or value > high or (open_low and value == low):
        raise RuleError(f"{where}: {value} lies outside {'(' if open_low else '['}{low}, {high}]")
    return float(value)


def _globs(where: str, value: Any) -> tuple[str, ...]:
    out = _strings(where, value)
    for g in out:
        try:
            glob_regex(g)
        except GlobError as e:
            raise RuleError(f"{where}: {e}") from None
    return out


def _pattern(where: str, pattern: Any, group: Any) -> None:
    if not isinstance(pattern, str):
        raise RuleError(f"{where}: the pattern must be a string")
    if bad := lint(pattern):
        raise RuleError(f"{where}: the pattern uses {', '.join(bad)}, which no linear-time engine has")
    try:
        p = compiled(pattern)
    except Exception as e:
        raise RuleError(f"{where}: bad pattern: {e}") from None
    if isinstance(group, bool) or not isinstance(group, (int, str)) or (isinstance(group, int) and not 0 <= group <= p.groups) or (isinstance(group, str) and group not in p.groupindex):
        raise RuleError(f"{where}: the pattern has no group {group!r}")


def compile_rule(raw: Any, origin: str) -> Rule:
    where = f"{origin}: rule {raw.get('id') if isinstance(raw, dict) else raw!r}"
    data = _keys(where, raw, {"id", "severity", "message"}, {"languages", "include", "exclude", *KINDS})
    if not isinstance(data["id"], str) or not ID.fullmatch(data["id"]):
        raise RuleError(f"{where}: an id has two or more dotted parts of a-z, 0-9 and -")
    if data["id"] == RESERVED:
        raise RuleError(f"{where}: this id is reserved")
    if data["severity"] not in RANK:
        raise RuleError(f"{where}: severity must be one of {', '.join(RANK)}")
    if not isinstance(data["message"], str):
        raise RuleError(f"{where}: the message must be a string")
    kinds = [k for k in KINDS if k in data]
    if len(kinds) != 1:
        raise RuleError(f"{where}: exactly one of {', '.join(KINDS)} is needed, {len(kinds)} are given")
    kind = kinds[0]
    languages = _strings(f"{where}: languages", data.get("languages", []))
    if "languages" in data and kind in ("ast", "boundary", "coverage", "duplication"):
        raise RuleError(f"{where}: languages can't be set on {kind} rules")
    common = dict(
        id=data["id"], severity=data["severity"], message=data["message"], kind=kind, languages=languages,
        include=_globs(f"{where}: include", data.get("include", [])), exclude=_globs(f"{where}: exclude", data.get("exclude", [])),
    )
    at, body = f"{where}: {kind}", data[kind]
    if kind == "regex":
        b = _keys(at, body, {"pattern"}, {"group", "redact"})
        _pattern(at, b["pattern"], b.get("group", 0))
        return Rule(**common, pattern=b["pattern"], group=b.get("group", 0), redact=bool(b.get("redact", False)))
    if kind == "secret":
        b = _keys(at, body, {"pattern"}, {"group", "entropy", "keywords", "allowlist"})
        _pattern(at, b["pattern"], b.get("group", 0))
        entropy = _number(f"{at}: entropy", b["entropy"], 0, math.inf) if b.get("entropy") is not None else None
        allow = _keys(f"{at}: allowlist", b.get("allowlist", {}), set(), {"patterns", "paths", "stopwords"})
        patterns = _strings(f"{at}: patterns", allow.get("patterns", []))
        for p in patterns:
            _pattern(f"{at}: allowlist", p, 0)
        return Rule(
            **common, pattern=b["pattern"], group=b.get("group", 0), entropy=entropy, keywords=tuple(k.lower() for k in _strings(f"{at}: keywords", b.get("keywords", []))),
            allow_patterns=patterns, allow_paths=_globs(f"{at}: paths", allow.get("paths", [])), stopwords=tuple(w.lower() for w in _strings(f"{at}: stopwords", allow.get("stopwords", []))),
        )
    if kind == "ast":
        from ..operators.syntax import QueryError, parse_query

        b = _keys(at, body, set(), set(LANGUAGES))
        if not b:
            raise RuleError(f"{at}: at least one language is needed")
        for language, query in b.items():
            try:
                parse_query(query)
            except QueryError as e:
                raise RuleError(f"{at}: {language}: {e}") from None
        return Rule(**{**common, "languages": tuple(b)}, queries=tuple(b.items()))
    if kind == "boundary":
        b = _keys(at, body, {"from", "deny"}, set())
        deny = _strings(f"{at}: deny", b["deny"])
        if not deny:
            raise RuleError(f"{at}: deny must name at least one silo")
        for name in (b["from"], *deny):
            if not isinstance(name, str) or not SILO.fullmatch(name):
                raise RuleError(f"{at}: {name!r} is no silo name")
        return Rule(**common, source=b["from"], deny=deny)
    if kind == "coverage":
        b = _keys(at, body, {"min"}, set())
        return Rule(**common, limit=_number(f"{at}: min", b["min"], 0, 100))
    b = _keys(at, body, {"max_percent"}, {"scope"})
    scope = b.get("scope", "scan")
    if scope not in SCOPES:
        raise RuleError(f"{at}: scope must be one of {', '.join(SCOPES)}")
    return Rule(**common, limit=_number(f"{at}: max_percent", b["max_percent"], 0, 100, True), scope=scope)


def load_text(text: str, origin: str = "<text>") -> RuleSet:
    """The rules of one YAML document; the first error in their order is raised."""
    text = "\n".join(text.split("\r\n"))
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuleError(f"{origin}: not YAML: {e}") from None
    data = _keys(origin, data, {"version", "rules"}, set())
    if data["version"] != 1 or isinstance(data["version"], bool):
        raise RuleError(f"{origin}: version {data['version']!r} isn't known, only 1 is")
    if not isinstance(data["rules"], list):
        raise RuleError(f"{origin}: rules must be a list")
    out, seen = [], set()
    for raw in data["rules"]:
        rule = compile_rule(raw, origin)
        if rule.id in seen:
            raise RuleError(f"{origin}: rule {rule.id}: more than one rule has this id")
        seen.add(rule.id)
        out.append(rule)
    return RuleSet(out, [(origin, text)])


def load_dirs(folders: list[str | Path]) -> RuleSet:
    """All ``*.yaml`` and ``*.yml`` files below the folders, in the order of their paths' bytes."""
    out = RuleSet()
    for folder in folders:
        folder = Path(folder)
        if not folder.is_dir():
            raise RuleError(f"{folder}: no such folder")
        for p in sorted((p for p in folder.rglob("*") if p.suffix in (".yaml", ".yml") and p.is_file()), key=lambda p: str(p).encode()):
            out = out.merged(load_text(p.read_text(encoding="utf-8"), str(p)))
    return out


def default_rules() -> RuleSet:
    """The packaged rules."""
    return load_text((Path(__file__).parent / "default.yaml").read_text(encoding="utf-8"), "default.yaml")


def require_rules(rules: RuleSet) -> RuleSet:
    if not rules.rules:
        raise RuleError("there are no rules to apply")
    return rules
