"""Rules from a TOML pack of secret rules (``[[rules]]`` with id, description, regex, entropy, keywords, allowlists)."""

from __future__ import annotations

import re
import tomllib

import yaml

from .loader import RuleError, compile_rule, lint


def convert(text: str, prefix: str = "secrets") -> tuple[str, list[tuple[str, str]]]:
    """(YAML text, [(id, why)] of rules left out): those without a pattern, with constructs that aren't supported, or that don't compile."""
    out, skipped = [], []
    for raw in tomllib.loads(text).get("rules", []):
        name = re.sub(r"[^a-z0-9-]+", "-", str(raw.get("id", "")).lower()).strip("-")
        if not raw.get("regex"):
            skipped.append((name, "no pattern"))
            continue
        if bad := lint(raw["regex"]):
            skipped.append((name, f"uses {', '.join(bad)}"))
            continue
        lists = raw.get("allowlists", []) + ([raw["allowlist"]] if "allowlist" in raw else [])
        allow = {
            "patterns": [p for a in lists for p in a.get("regexes", []) if a.get("regexTarget", "secret") == "secret" and not lint(p)],
            "stopwords": [w for a in lists for w in a.get("stopwords", [])],
        }
        payload = {"pattern": raw["regex"], "group": raw.get("secretGroup") or min(1, re.compile(r"\((?!\?)").search(raw["regex"]) is not None)}
        payload |= {k: raw[k] for k in ("entropy", "keywords") if raw.get(k)}
        payload |= {"allowlist": {k: v for k, v in allow.items() if v}} if any(allow.values()) else {}
        rule = {"id": f"{prefix}.{name}", "severity": "error", "message": str(raw.get("description", name)), "secret": payload}
        try:
            compile_rule(rule, "converted")
        except RuleError as e:
            skipped.append((name, str(e)))
            continue
        out.append(rule)
    return yaml.safe_dump({"version": 1, "rules": out}, sort_keys=False, allow_unicode=True), skipped
