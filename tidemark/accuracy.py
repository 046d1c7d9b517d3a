"""Accuracy against labelled lines: greedy matching, metrics by family, reports, a gate."""

from __future__ import annotations

import json
import os
import re

from tidemark.engine import scan
from tidemark.operators.scoring import FAMILIES, TOLERANCE

#: What the gate asks for.
LEAST_PRECISION, LEAST_RECALL = 0.70, 0.85


def family_of(kinds: list[str]) -> str:
    return next((f for f in FAMILIES if f in kinds), "unknown")


def metrics(tp: int, fp: int, fn: int) -> dict:
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return {"tp": tp, "fp": fp, "fn": fn, "precision": round(p, 3), "recall": round(r, 3), "f1": round(2 * p * r / (p + r) if p + r else 0.0, 3)}


def score(cases: list[dict], clean: list[dict], findings: list[dict], tolerance: int = TOLERANCE) -> dict:
    """cases and clean: file, line, family. Each case takes the first free finding of its file and family that is near enough; free ones left over are false."""
    free = list(findings)
    counts = {f: {"tp": 0, "fp": 0, "fn": 0} for f in FAMILIES}
    missed = []
    near = lambda f, c: f["relative_path"] == c["file"] and abs(f["range"]["start"]["line"] - c["line"]) <= tolerance
    for c in cases:
        hit = next((f for f in free if near(f, c) and c["family"] in f["kinds"]), None)
        counts[c["family"]]["tp" if hit else "fn"] += 1
        free.remove(hit) if hit else missed.append(c)
    for f in free:
        counts.setdefault(family_of(f["kinds"]), {"tp": 0, "fp": 0, "fn": 0})["fp"] += 1
    overall = metrics(*(sum(c[k] for c in counts.values()) for k in ("tp", "fp", "fn")))
    families = {f: metrics(**c) for f, c in counts.items() if any(c.values())}
    return {"overall": overall, "families": families, "false": free, "missed": missed, "clean_hits": sum(any(near(f, c) for f in free) for c in clean)}


def run(folder: str, manifest: str | None = None, spark=None) -> dict:
    """Scan a labelled folder with the built-in rules. manifest.json: tolerance, vulnerable and clean lists of file, line, family."""
    with open(manifest or os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        given = json.load(f)
    result = scan(folder, spark, distributed=spark is not None, builtin_only=True)
    return score(given.get("vulnerable", []), given.get("clean", []), result["findings"], given.get("tolerance", TOLERANCE)) | {"total": len(result["findings"])}


def render(report: dict) -> str:
    rows = [("overall", report["overall"]), *sorted(report["families"].items())]
    lines = ["| family | precision | recall | F1 | TP/FP/FN |", "| --- | ---: | ---: | ---: | --- |"]
    lines += [f"| {n} | {m['precision']:.3f} | {m['recall']:.3f} | {m['f1']:.3f} | {m['tp']}/{m['fp']}/{m['fn']} |" for n, m in rows]
    return "\n".join(lines) + "\n"


def embed(document: str, section: str, name: str = "accuracy") -> str:
    """The document with the section between its two markers replaced; without markers it is appended."""
    begin, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    block = f"{begin}\n{section.rstrip()}\n{end}"
    pattern = re.compile(re.escape(begin) + ".*?" + re.escape(end), re.S)
    return pattern.sub(lambda _: block, document) if pattern.search(document) else document.rstrip("\n") + f"\n\n{block}\n"


def passes(report: dict) -> bool:
    return report["overall"]["precision"] >= LEAST_PRECISION and report["overall"]["recall"] >= LEAST_RECALL
