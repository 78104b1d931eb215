"""``python -m auditlake.cli scan|baseline|test|cache PATH``: exit status 0, 1 (a new finding fails the run) or 2 (it can't be evaluated)."""

from __future__ import annotations

import argparse
import os
import re
import secrets
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import harness
from .config import Config, ConfigError, discover
from .config import load as load_config
from .model import SEVERITIES
from .plans.scan import Report, Scanner, SetupError
from .rulesets.loader import RuleError, RuleSet, default_rules, load_dirs
from .session import prepare
from .sinks import reports as sinks
from .sources import files as sources
from .sources.reports import ReportError, read_baseline, read_coverage
from .streaming.incremental import Cache

BASELINE = "auditlake-baseline.json"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="auditlake")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "baseline", "test"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("--config")
        c.add_argument("--rules", action="append", default=[], help="a folder of YAML rules")
        c.add_argument("--no-default-rules", action="store_true")
        c.add_argument("--no-gitignore", action="store_true")
        c.add_argument("--no-ignore", action="store_true")
        c.add_argument("--all-files", action="store_true")
        c.add_argument("--follow-links", action="store_true")
        c.add_argument("--baseline")
        if name == "baseline":
            c.add_argument("--dry-run", action="store_true", help="tells what would change and writes nothing")
        if name in ("scan", "baseline"):
            c.add_argument("--cache", help="a folder that keeps what was found from scan to scan")
        if name == "scan":
            c.add_argument("--coverage-report")
            c.add_argument("--format", choices=("text", "json", "sarif"), default="text")
            c.add_argument("--min-severity", choices=SEVERITIES)
            c.add_argument("--fail-on", choices=SEVERITIES, default="error")
    c = commands.add_parser("cache")
    c.add_argument("path", help="the folder of a cache")
    c.add_argument("--prune-days", type=int, help="drops what was written longer ago")
    return p


def _cache(spark: SparkSession, folder: str | None) -> Cache | None:
    """The cache of a folder; its salt lies beside it, for its owner only."""
    if folder is None:
        return None
    salt = Path(f"{folder.rstrip('/')}.salt")
    if not salt.exists():
        salt.parent.mkdir(parents=True, exist_ok=True)
        with os.fdopen(os.open(salt, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write(secrets.token_hex(16))
    return Cache(spark, str(Path(folder).resolve()), salt.read_text())


def safe(text: str) -> str:
    """Text without controls that could steer a terminal."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]", lambda m: f"\\x{ord(m[0]):02x}" if ord(m[0]) < 256 else f"\\u{{{ord(m[0]):04x}}}", text)


def _rules(args: argparse.Namespace, config: Config) -> RuleSet:
    home = config.path.parent if config.path else Path(".")
    folders = [*(home / r for r in config.rules), *args.rules]
    out = RuleSet() if args.no_default_rules else default_rules()
    return out.merged(load_dirs(folders)) if folders else out


def _scan(spark: SparkSession, args: argparse.Namespace, config: Config, rules: RuleSet, accepted: bool) -> Report:
    root = Path(args.path)
    policy = sources.Policy.everything() if args.all_files else sources.Policy(gitignore=not args.no_gitignore, ignore=not args.no_ignore, follow_links=args.follow_links)
    outer = sources.project_ignores(config.path.parent, root, policy) if config.anchor == "config" and config.path else None
    walked = sources.walk(root, policy, outer)
    read = sources.read_tree(spark, root, walked, config.prefix(root))
    known = read_baseline(spark, str(_baseline(args, config)), args.baseline is not None) if accepted else None
    coverage = read_coverage(spark, args.coverage_report) if getattr(args, "coverage_report", None) else None
    inside = config.path is not None and root.resolve() != config.path.parent.resolve()
    report = Scanner(spark, rules, config, _cache(spark, getattr(args, "cache", None))).scan(read.where("kind = 'text'").select("path", "content"), known, coverage, read.where("kind = 'unreadable'").select("path", F.coalesce("reason", F.lit("unreadable")).alias("reason")), inside)
    report.ignored = (walked.ignored_files, walked.ignored_directories)
    return report


def _baseline(args: argparse.Namespace, config: Config) -> Path:
    root = Path(args.path)
    home = config.path.parent if config.anchor == "config" and config.path else root if root.is_dir() else root.parent
    return Path(args.baseline) if args.baseline else home / BASELINE


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "cache":
            store = _cache(prepare(spark or SparkSession.builder.appName("auditlake").getOrCreate()), args.path)
            if args.prune_days is not None:
                print(f"{store.prune(args.prune_days)} days dropped")
            print(f"{store.read().count()} entries of {len(store.days())} days")
            return 0
        if not Path(args.path).exists():
            raise ConfigError(f"{args.path}: no such file or folder")
        config = load_config(args.config) if args.config else discover(args.path) or Config()
        rules = _rules(args, config)
        spark = prepare(spark or SparkSession.builder.appName("auditlake").getOrCreate())
        if args.command == "test":
            read = sources.read_tree(spark, args.path, prefix=config.prefix(args.path)).where("kind = 'text'").select("path", "content")
            rows = harness.run(read, rules).where("outcome <> 'matched'").orderBy("path", "line", "rule_id").collect()
            print("\n".join(f"{r['path']}:{r['line']} {r['outcome']} {r['rule_id']}" for r in rows) or "all expectations are met")
            return int(bool(rows))
        if args.command == "baseline":
            report = _scan(spark, args, config, rules, False)
            if args.dry_run:
                old, now = read_baseline(spark, str(_baseline(args, config))).select("fingerprint").distinct(), report.findings.select("fingerprint").distinct()
                print(f"{now.join(old, 'fingerprint', 'left_anti').count()} findings would be added, {old.join(now, 'fingerprint', 'left_anti').count()} dropped")
                return 0
            sinks.write_baseline(report.findings, _baseline(args, config))
            print(f"{report.findings.count()} findings accepted")
            return 0
        report = _scan(spark, args, config, rules, True)
        if args.format == "json":
            print(sinks.json_report(report, least=args.min_severity))
        elif args.format == "sarif":
            print(sinks.sarif_report(report, rules, least=args.min_severity))
        else:
            print(sinks.text_report(report, args.min_severity), end="")
        for w in [*report.warnings, *(sinks.skip_warnings(report.skipped) if args.format == "text" else [])]:
            print(f"warning: {safe(w)}", file=sys.stderr)
        return sinks.exit_status(report, args.fail_on)
    except (ConfigError, RuleError, SetupError, ReportError, OSError) as e:
        print(f"auditlake: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
