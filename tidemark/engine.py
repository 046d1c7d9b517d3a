"""The engine's facade: scan a project, or run the kernel on tables.

A project is scanned in this process, with the kernel's local twin, unless a session is given and its files exceed LOCAL_BYTES or distributed is True; then it is scanned by Spark: files are parsed in parallel, rules join nodes, the fixpoint loops over
tables, and only ordered findings are collected for the report.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from tidemark import __version__
from tidemark.frontend.builder import build_bytes, build_file, problem
from tidemark.functions.text import path_matches
from tidemark.plans.local import LocalSolver
from tidemark.plans.model import SolveOptions
from tidemark.reporters import count_by_severity, rank, summary_line
from tidemark.rules.annotate import annotate_rows
from tidemark.sources.config import Config, resolve_config
from tidemark.sources.discovery import Selection, discover_files, folder_of, readable

ENGINE_VERSION = __version__
TOOL_NAME, TOOL_VERSION = "tidemark", __version__
LOCAL_BYTES = 64 << 20

__all__ = ["ENGINE_VERSION", "TOOL_NAME", "TOOL_VERSION", "count_by_severity", "prepare", "scan", "scan_source", "should_fail", "summary_line"]


def solve_options(config: Config) -> SolveOptions:
    notes = {s["id"]: s["description"] for s in config.rules["sources"] if s.get("description")}
    return SolveOptions(max_iterations=config.max_iterations, max_call_depth=config.max_call_depth, dedupe=config.dedupe, kinds=tuple(config.kinds) if config.kinds else None, source_notes=notes)


def prepare(root: str, config_path: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, overrides: dict | None = None, builtin_only: bool = False) -> tuple[Config, list[str], str, list[dict]]:
    """Configuration, files, the folder that paths are relative to, diagnostics."""
    config = resolve_config(root, config_path, overrides, builtin_only)
    files, said = discover_files(root, include, [*config.ignore_paths, *(exclude or [])])
    files, unread = readable(files)
    return config, files, folder_of(root), said + unread + _warnings(config)


def _warnings(config: Config) -> list[dict]:
    return [{"level": "warning", "message": w, "file": None, "range": None} for w in config.warnings]


def _merged(parts: list[dict[str, list[dict]]]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for part in parts:
        for k, rows in part.items():
            out.setdefault(k, []).extend(rows)
    return out


def _solve_rows(tables: dict[str, list[dict]], config: Config) -> tuple[list[dict], dict, list[dict]]:
    occurrences = annotate_rows(tables, config.rules)
    options = solve_options(config)
    solver = LocalSolver(tables | occurrences, options)
    solved = solver.run()
    findings = solver.findings(solved, {s["id"] for s in config.rules["sinks"]})
    said = [{"level": "warning", "message": f"analysis of {f} stopped at its limit of {options.max_iterations} states", "file": None, "range": None} for f in solved["truncated"]]
    said += [{"level": "info", "message": f"recursion into {f} stopped at depth {options.max_call_depth}", "file": None, "range": None} for f in solved["capped"]]
    stats = {"functions_analysed": sum(not f["is_module_scope"] for f in tables["functions"]), "nodes": len(tables["nodes"]), "edges": len(tables["edges"]), "iterations": len(solved["states"]), "truncated": solved["truncated"]}
    return findings, stats, said


def scan_source(source: str, path: str = "input.ts", config: Config | None = None) -> dict:
    """One text."""
    config = config or Config()
    tables = build_file(source, path)
    findings, stats, said = _solve_rows(tables, config)
    return {"root": "", "findings": findings, "stats": {"files_scanned": 1, **stats}, "diagnostics": tables["diagnostics"] + said, "config": config}


def scan(root: str, spark=None, distributed: bool | None = None, config_path: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, overrides: dict | None = None, builtin_only: bool = False, on_progress: Callable[[str, str], None] | None = None) -> dict:
    """root, findings (ordered rows), stats, diagnostics, config."""
    began, tell = time.time(), on_progress or (lambda phase, text: None)
    tell("discover", root)
    if not distributed:
        config, files, base, said = prepare(root, config_path, include, exclude, overrides, builtin_only)
        if distributed is None:
            distributed = spark is not None and sum(os.path.getsize(f) for f in files if os.path.isfile(f)) > LOCAL_BYTES
    if distributed:
        config, base = resolve_config(root, config_path, overrides, builtin_only), folder_of(root)
        said = _warnings(config)
        findings, stats, more = _scan_tables(spark, root, Selection.of(include, [*config.ignore_paths, *(exclude or [])]), config, tell)
    else:
        tell("parse", f"{len(files)} files")
        parts = []
        for f in files:
            with open(f, "rb") as source:
                parts.append(build_bytes(source.read(), os.path.relpath(f, base).replace(os.sep, "/"), f))
        empty = {k: [] for k in ("functions", "nodes", "edges", "call_sites", "callback_links", "diagnostics", "aliases")}
        tables = _merged([empty, *parts])
        tell("solve", f"{len(tables['nodes'])} nodes")
        findings, stats, more = _solve_rows(tables, config)
        stats = {"files_scanned": len(files), **stats}
        more = tables["diagnostics"] + more
    tell("report", f"{len(findings)} findings")
    return {"root": base, "findings": findings, "stats": {**stats, "elapsed_ms": round((time.time() - began) * 1000)}, "diagnostics": said + more, "config": config}


def analyse_files(spark, files, config: Config, proofs: bool = True):
    """files (relative_path, and text or content) as a table -> the kernel's Result and the diagnostics table. This is the path for corpora of any size; nothing is collected."""
    from pyspark.sql import functions as F

    from tidemark.plans.findings import analyse
    from tidemark.plans.model import Occurrences, checkpointed, let_go
    from tidemark.rules.annotate import annotate, complete, expressions
    from tidemark.rules.catalogue import rule_tables
    from tidemark.sources.discovery import graph_tables

    graph, aliases, diagnostics = graph_tables(files)
    last = aliases.groupBy("scope", "name").agg(F.max_by("chain", "seq").alias("chain"))
    rules = rule_tables(spark, complete(config.rules))
    read = checkpointed(expressions(graph.nodes, last))
    let_go(spark)
    found = annotate(graph, rules, read)
    occurrences = Occurrences(*map(checkpointed, (found.sources, found.sanitizers, found.sinks)))
    let_go(spark)
    return analyse(graph, occurrences, rules["sinks"], solve_options(config), proofs), diagnostics


def file_findings(spark, files, config: Config, proofs: bool = True):
    """files (relative_path, and text or content) as a table -> the findings of analyse_files alone. Files of one text are analysed once, and each gets the findings.

    Nothing passes from one file to another, so what a text leads to differs between its files in their paths only: texts are analysed under their digests, which paths then take the place of. seq orders the findings of a file, not those of different ones.
    A rule that names functions by path looks at paths, so with one each file is analysed by itself. files is read twice, once for the texts and once for who has them.
    """
    from pyspark.sql import functions as F

    from tidemark.functions.text import finding_id
    from tidemark.plans.model import checkpointed, small

    if any("::" in f for r in config.rules["sources"] for f in r.get("within_functions") or ()):
        return analyse_files(spark, files, config, proofs)[0].findings
    source = "content" if "content" in files.columns else "text"
    if "unread" in files.columns:
        files = files.where("unread is null")
    files = files.withColumn(source, F.coalesce(source, F.lit("").cast(files.schema[source].dataType)))
    digest = F.sha2(source, 256)
    texts = checkpointed(files.select(source).distinct().select(digest.alias("relative_path"), source))
    found = analyse_files(spark, texts, config, proofs)[0].findings.withColumnsRenamed({"relative_path": "digest", "function_id": "inner"})
    every = files.select("relative_path", digest.alias("digest")).join(small(found), "digest")
    moved = lambda c: F.concat("relative_path", F.substring(c, 65, 1 << 30))  # noqa: E731 - a digest has 64 digits
    own = {"id": finding_id(F.col("rule_id"), F.col("relative_path"), F.col("range.start.line"), F.col("range.start.column")), "file": F.col("relative_path"), "function_id": moved(F.col("inner"))}
    if proofs:
        own["proof"] = F.transform("proof", lambda s: s.withField("node_id", moved(s["node_id"])).withField("file", F.col("relative_path")))
    return every.withColumns(own).drop("digest", "inner")


def _scan_tables(spark, root: str, wanted: Selection, config: Config, tell) -> tuple[list[dict], dict, list[dict]]:
    from tidemark.plans.findings import ordered
    from tidemark.sources.tree import list_tree, read_tree

    base = folder_of(root)
    files, unlisted = list_tree(spark, root, wanted)
    count = files.count()
    tell("parse", f"{count} files")
    tell("solve", "tables")
    result, diagnostics = analyse_files(spark, read_tree(files, root), config)
    findings = [r.asDict(True) for r in ordered(result.findings).collect()]
    for f in findings:  # the tables know relative paths only
        f["file"] = os.path.join(base, f["relative_path"])
        for s in f["proof"]:
            s["file"] = os.path.join(base, s["file"])
    stats = {"files_scanned": count, "functions_analysed": result.stats["functions"], **{k: result.stats[k] for k in ("nodes", "edges", "iterations", "truncated")}}
    said = [problem(r["message"], os.path.join(base, r["file"]) if r["file"] else base) for r in unlisted.orderBy("file").collect()]
    said += [r.asDict(True) | {"file": os.path.join(base, r["file"])} for r in diagnostics.orderBy("file", "message").collect()] + [{"level": level, "message": m, "file": None, "range": None} for level, m, _ in result.diagnostics]
    return findings, stats, said


def should_fail(result: dict, threshold: str) -> bool:
    return threshold != "none" and any(rank(f["severity"]) >= rank(threshold) for f in result["findings"])


def ignored(path: str, config: Config) -> bool:
    return path_matches(path, config.ignore_paths)
