"""Scan configuration in TOML: strict keys, silos, limits, anchor and single-level includes."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath
from typing import Any

from .functions.paths import GlobError, glob_regex
from .rulesets.loader import SILO

NAME = "auditlake.toml"
_LISTS = ("source_roots", "rules", "include")


class ConfigError(ValueError):
    """A configuration that can't be used; the message names the file and the key."""


@dataclass
class Config:
    silos: dict[str, list[str]] = field(default_factory=dict)
    source_roots: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    languages: dict[str, str] = field(default_factory=dict)  # accepted; detection goes by its fixed table
    min_lines: int = 10
    report_blocks: bool = False
    max_parse_bytes: int = 2 << 20
    anchor: str = "scan-root"
    include: list[str] = field(default_factory=list)
    path: Path | None = None

    def prefix(self, root: str | Path) -> str:
        """What stands before every path: nothing, or the scan root as seen from the configuration."""
        if self.anchor == "scan-root":
            return ""
        if self.path is None:
            raise ConfigError("anchor 'config' needs a configuration file")
        home, root = self.path.parent.resolve(), Path(root).resolve()
        if root != home and home not in root.parents:
            raise ConfigError(f"{root} lies outside {home}, so paths can't be anchored there")
        return "" if root == home else root.relative_to(home).as_posix()


def _inside(at: str, value: str) -> None:
    p = PurePosixPath(value)
    if p.is_absolute() or ".." in p.parts:
        raise ConfigError(f"{at}: {value!r} leaves the folder of the configuration")


def parse(text: str, origin: str = "<text>", included: bool = False) -> Config:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{origin}: not TOML: {e}") from None
    known = {"silos", "source_roots", "rules", "languages", "duplication", "limits", "anchor", "include"}
    for k in data:
        if k not in known:
            raise ConfigError(f"{origin}: unknown key {k!r}")

    def table(name: str, keys: set[str] | None) -> dict[str, Any]:
        out = data.get(name, {})
        if not isinstance(out, dict):
            raise ConfigError(f"{origin}: {name} must be a table")
        for k in out:
            if keys is not None and k not in keys:
                raise ConfigError(f"{origin}: unknown key {name}.{k}")
        return out

    out = Config()
    for name in _LISTS:
        value = data.get(name, [])
        if not isinstance(value, list) or any(not isinstance(x, str) for x in value):
            raise ConfigError(f"{origin}: {name} must be a list of strings")
        for x in value:
            _inside(f"{origin}: {name}", x)
        setattr(out, name, value)
    for name, globs in table("silos", None).items():
        if not SILO.fullmatch(name):
            raise ConfigError(f"{origin}: {name!r} is no silo name")
        if not isinstance(globs, list) or any(not isinstance(g, str) for g in globs):
            raise ConfigError(f"{origin}: silo {name} must be a list of globs")
        for g in globs:
            _inside(f"{origin}: silo {name}", g)
            try:
                glob_regex(g)
            except GlobError as e:
                raise ConfigError(f"{origin}: silo {name}: {e}") from None
        out.silos[name] = globs
    languages = table("languages", None)
    if any(not isinstance(v, str) for v in languages.values()):
        raise ConfigError(f"{origin}: languages must map extensions to names")
    out.languages = languages
    duplication, limits = table("duplication", {"min_lines", "report_blocks"}), table("limits", {"max_parse_bytes"})

    def whole(at: str, value: Any, least: int) -> int:
        if isinstance(value, bool) or not isinstance(value, int) or value < least:
            raise ConfigError(f"{origin}: {at} must be a whole number of at least {least}")
        return value

    out.min_lines = whole("duplication.min_lines", duplication.get("min_lines", 10), 2)
    out.max_parse_bytes = whole("limits.max_parse_bytes", limits.get("max_parse_bytes", 2 << 20), 1)
    out.report_blocks = duplication.get("report_blocks", False)
    if not isinstance(out.report_blocks, bool):
        raise ConfigError(f"{origin}: duplication.report_blocks must be true or false")
    out.anchor = data.get("anchor", "scan-root")
    if out.anchor not in ("scan-root", "config"):
        raise ConfigError(f"{origin}: anchor must be 'scan-root' or 'config'")
    if included and out.include:
        raise ConfigError(f"{origin}: an included configuration can't include others")
    return out


def _held(config: Config, folder: Path, home: Path, origin: str) -> None:
    """Refuses source roots, rule folders and the fixed parts of silos' globs that lead out of the configuration's folder by way of links."""
    fixed = {g: re.match(r"(?:[^*?\[{\\]*/)?", g)[0] for globs in config.silos.values() for g in globs}
    for name, place in [*((x, x) for x in (*config.source_roots, *config.rules)), *fixed.items()]:
        real = (folder / place).resolve()
        if real != home and home not in real.parents:
            raise ConfigError(f"{origin}: {name!r} leaves the folder of the configuration through a link")


def load(path: str | Path) -> Config:
    """A configuration with what it includes: their silos and roots, with their folder in front."""
    path = Path(path)
    out = parse(path.read_text(encoding="utf-8"), str(path))
    out.path = path
    home = path.parent.resolve()
    _held(out, path.parent, home, str(path))
    for name in out.include:
        part_path = path.parent / name
        if part_path.is_dir():
            part_path = part_path / NAME
        if not part_path.is_file():
            raise ConfigError(f"{path}: include {name!r} isn't there")
        real = part_path.resolve()
        if home not in real.parents:
            raise ConfigError(f"{path}: include {name!r} leaves the folder of the configuration")
        part = parse(part_path.read_text(encoding="utf-8"), str(part_path), included=True)
        _held(part, real.parent, home, str(part_path))
        base = real.parent.relative_to(home).as_posix()
        rebase = (lambda x: x) if base == "." else (lambda x, base=base: f"{base}/{x}")
        for silo, globs in part.silos.items():
            if silo in out.silos:
                raise ConfigError(f"{path}: silo {silo!r} is declared here and in {part_path}")
            out.silos[silo] = [rebase(g) for g in globs]
        out.source_roots += [r for r in map(rebase, part.source_roots) if r not in out.source_roots]
        out.rules += [r for r in map(rebase, part.rules) if r not in out.rules]
    return out


def discover(root: str | Path) -> Config | None:
    """The nearest configuration at or above ``root``; one above counts only within a version-controlled tree. A module that an ancestor includes defers to it."""
    root = Path(root).resolve()
    folder = root if root.is_dir() else root.parent
    versioned = next((p for p in (folder, *folder.parents) if (p / ".git").exists()), None)
    found: Path | None = None
    for p in (folder, *folder.parents):
        if not (p / NAME).is_file():
            continue
        if p != folder and (versioned is None or (p != versioned and versioned not in p.parents)):
            break
        if found is None:
            found = p / NAME
            continue
        for name in parse((p / NAME).read_text(encoding="utf-8"), str(p / NAME)).include:
            target = (p / name).resolve()
            if target in (found.resolve(), found.parent.resolve()):
                return load(p / NAME)
    return load(found) if found else None
