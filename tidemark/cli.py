"""Command line: scan, rules, explain."""

from __future__ import annotations

import argparse
import json
import os
import sys

from tidemark import __version__
from tidemark.engine import scan, should_fail
from tidemark.frontend.builder import build_file
from tidemark.reporters import create_reporter
from tidemark.rules.annotate import annotate_rows
from tidemark.rules.catalogue import builtin_rules
from tidemark.sources.config import FAIL_ON, FORMATS, ConfigError, resolve_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tidemark", description="find untrusted data that reaches dangerous places")
    p.add_argument("-v", "--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="scan a folder or a file")
    s.add_argument("path", nargs="?", default=".")
    s.add_argument("-f", "--format", choices=FORMATS)
    s.add_argument("-o", "--output")
    s.add_argument("--config")
    s.add_argument("--include", action="append")
    s.add_argument("--exclude", action="append")
    s.add_argument("--fail-on", choices=FAIL_ON)
    s.add_argument("--max-call-depth", type=int)
    s.add_argument("--distributed", action="store_true", help="scan with Spark, in the session that spark-submit or the environment configures")
    s.add_argument("--no-color", action="store_true")
    s.add_argument("-q", "--quiet", action="store_true")
    r = sub.add_parser("rules", help="list the built-in rules")
    r.add_argument("--json", action="store_true")
    e = sub.add_parser("explain", help="what rules say about a line")
    e.add_argument("place", help="file:line")
    e.add_argument("--config")
    e.add_argument("--json", action="store_true")
    return p


def run_scan(a: argparse.Namespace) -> int:
    """0 without gated findings, 1 with, 2 if something couldn't be read or configured."""
    progress = None if a.quiet else lambda phase, text: print(f"{phase}: {text}", file=sys.stderr)
    try:
        spark = None
        if a.distributed:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("tidemark").getOrCreate()
        result = scan(a.path, spark, a.distributed or None, config_path=a.config, include=a.include, exclude=a.exclude, overrides={"format": a.format, "output": a.output, "fail_on": a.fail_on, "max_call_depth": a.max_call_depth}, on_progress=progress)
    except ConfigError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    config = result["config"]
    options = {"colour": not a.no_color and not config.output and sys.stdout.isatty()} if config.format == "pretty" else {}
    text = create_reporter(config.format, **options)(result)
    if config.output:
        with open(config.output, "w", encoding="utf-8") as f:
            f.write(text)
        print(f"wrote {config.output}")
    else:
        sys.stdout.write(text if text.endswith("\n") else text + "\n")
    if any(d["level"] == "error" for d in result["diagnostics"]):
        return 2
    return int(should_fail(result, config.fail_on))


def run_rules(a: argparse.Namespace) -> int:
    rules = builtin_rules()
    if a.json:
        print(json.dumps(rules, indent=2))
    else:
        for kind, own in rules.items():
            print(f"{kind} ({len(own)})")
            for r in own:
                pattern = " ".join(f"{k}={r[k]}" for k in ("member", "identifier", "call") if r.get(k))
                print(f"  {r.get('id', '')}  {pattern}  {','.join(r.get('kinds', []))}".rstrip())
    return 0


def run_explain(a: argparse.Namespace) -> int:
    file, _, line = a.place.rpartition(":")
    if not file or not line.isdigit():
        print("give a place as file:line", file=sys.stderr)
        return 2
    try:
        with open(file, encoding="utf-8") as f:
            tables = build_file(f.read(), os.path.basename(file), os.path.abspath(file))
        rules = resolve_config(os.path.dirname(os.path.abspath(file)), a.config, builtin_only=a.config is None).rules
    except (OSError, ConfigError) as e:
        print(e, file=sys.stderr)
        return 2
    found = {k: [r for r in rows if r["range"]["start"]["line"] == int(line)] for k, rows in annotate_rows(tables, rules).items()}
    if a.json:
        print(json.dumps(found, indent=2))
    else:
        for kind, rows in found.items():
            for r in rows:
                state = "" if r.get("valid", True) else f" (no effect: {r['invalid_reason']})"
                print(f"{kind[:-1]} {r.get('source_id') or r.get('sanitizer_id') or r.get('sink_id')} at column {r['range']['start']['column']}: {', '.join(r['kinds'])}{state}")
        if not any(found.values()):
            print("no rule matches on this line")
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 2
    return {"scan": run_scan, "rules": run_rules, "explain": run_explain}[a.command](a)


if __name__ == "__main__":
    sys.exit(main())
