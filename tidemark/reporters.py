"""Reports as text: JSON, SARIF 2.1.0, Markdown, terminal. All take the finished envelope and give the same bytes for the same input."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from typing import Any
from urllib.parse import quote, urlsplit

from tidemark import __version__
from tidemark.functions.text import SEVERITIES

TOOL = "tidemark"
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"
INFORMATION_URI = "https://example.org/tidemark"


def rank(severity: str) -> int:
    return SEVERITIES.index(severity)


def count_by_severity(findings: list[dict]) -> dict[str, int]:
    return {s: sum(f["severity"] == s for f in findings) for s in reversed(SEVERITIES)}


def summary_line(findings: list[dict]) -> str:
    if not findings:
        return "no findings"
    counts = ", ".join(f"{n} {s}{'s' * (n > 1)}" for s, n in count_by_severity(findings).items() if n)
    files = len({f["file"] for f in findings})
    return f"{len(findings)} finding{'s' * (len(findings) > 1)} ({counts}) in {files} file{'s' * (files > 1)}"


def without_nulls(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


_FINDING = ("id", "ruleId", "severity", "message", "advice", "cwe", "kinds", "sourceId", "sinkId", "file", "relativePath", "range", "functionId", "proof")
_STEP = ("nodeId", "file", "range", "label", "role", "note")


def _camel(name: str) -> str:
    return re.sub(r"_(.)", lambda m: m[1].upper(), name)


def finding_dto(f: dict) -> dict:
    """A finding with its keys in order; keys without a value are left out."""
    own = {_camel(k): v for k, v in f.items()}
    own["proof"] = [{k: {_camel(a): b for a, b in s.items()}.get(k) for k in _STEP} for s in f.get("proof") or []]
    return without_nulls({k: own.get(k) for k in _FINDING})


def render_json(result: dict) -> str:
    """Time spent is left out, so that equal input gives equal bytes."""
    stats = {_camel(k): v for k, v in result["stats"].items() if k != "elapsed_ms"}
    body = {"tool": {"name": TOOL, "version": __version__}, "root": result["root"], "findings": [finding_dto(f) for f in result["findings"]], "stats": stats, "diagnostics": without_nulls(result["diagnostics"])}
    return json.dumps(body, indent=2, ensure_ascii=False) + "\n"


# ---- SARIF -------------------------------------------------------------------------------------------------------

_LEVELS = {"info": "note", "warning": "warning", "error": "error", "note": "note"}


def one_line(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f]", " ", text)).strip()


def artifact_uri(path: str | None) -> str:
    plain = re.sub(r"^(\./)+", "", (path or "").replace("\\", "/"))
    return "/".join(quote(p, safe="-_.!~*'()") for p in plain.split("/")) or "(unknown)"


def cwe_number(cwe: str) -> str | None:
    return m[1] if (m := re.search(r"(\d+)", cwe)) else None


def cwe_url(cwe: str) -> str | None:
    return f"https://cwe.mitre.org/data/definitions/{int(n)}.html" if (n := cwe_number(cwe)) else None


def region(r: dict) -> dict:
    """One-based and not inverted; ranges are stored with an exclusive end, as regions are."""
    start = (max(1, r["start"]["line"]), max(1, r["start"]["column"]))
    end = max(start, (max(1, r["end"]["line"]), max(1, r["end"]["column"])))
    return {"startLine": start[0], "startColumn": start[1], "endLine": end[0], "endColumn": end[1]}


def rule_descriptors(findings: list[dict]) -> list[dict]:
    """Rules that were met, by id: highest severity, first text that isn't blank, weaknesses and tags in order of appearance."""
    out: dict[str, dict] = {}
    for f in findings:
        r = out.setdefault(f["rule_id"], {"id": f["rule_id"], "severity": f["severity"], "message": "", "advice": "", "cwe": [], "kinds": []})
        r["severity"] = max(r["severity"], f["severity"], key=rank)
        for k in ("message", "advice"):
            r[k] = r[k] or (f[k] or "").strip()
        for k in ("cwe", "kinds"):
            r[k] += [x for x in f[k] or [] if x not in r[k]]
    return [out[k] for k in sorted(out)]


def _descriptor(r: dict) -> dict:
    tags = ["security", *r["kinds"], *(f"external/cwe/cwe-{int(n):03d}" for c in r["cwe"] if (n := cwe_number(c)))]
    help_text = r["advice"] or r["message"]
    return without_nulls({
        "id": r["id"], "name": r["id"], "shortDescription": {"text": one_line(r["message"] or r["id"])}, "fullDescription": {"text": one_line(r["message"] or r["id"])},
        "helpUri": next((u for c in r["cwe"] if (u := cwe_url(c))), None), "help": {"text": help_text or r["id"], "markdown": f"**{r['id']}**\n\n{help_text}"},
        "defaultConfiguration": {"level": _LEVELS[r["severity"]]}, "properties": {"tags": tags},
    })


def _location(file: str, r: dict | None, text: str | None = None) -> dict:
    physical = {"artifactLocation": {"uri": artifact_uri(file), "uriBaseId": "%SRCROOT%"}}
    return {"physicalLocation": physical | ({"region": region(r)} if r else {})} | ({"message": {"text": one_line(text)}} if text else {})


def shortened(file: str, root: str | None) -> str:
    return file[len(root.rstrip("/")) + 1 :] if root and file.startswith(root.rstrip("/") + "/") else file


def infer_root(findings: list[dict]) -> str | None:
    return next((f["file"][: -len(f["relative_path"]) - 1] for f in findings if f["file"].endswith("/" + f["relative_path"])), None)


def render_sarif(result: dict, information_uri: str = INFORMATION_URI) -> str:
    findings, root = result["findings"], result.get("root") or infer_root(result["findings"])
    rules = rule_descriptors(findings)
    index = {r["id"]: i for i, r in enumerate(rules)}
    if urlsplit(information_uri).scheme == "":
        information_uri = INFORMATION_URI
    results = []
    for f in findings:
        steps = []
        for n, s in enumerate(f.get("proof") or [], 1):
            message = f"{s['role']}: {s['label']}" + (f" ({s['note']})" if s.get("note") else "")
            steps.append({"location": _location(shortened(s["file"], root), s["range"], message), "executionOrder": n, "importance": "essential" if s["role"] in ("source", "sink") else "important"})
        results.append({
            "ruleId": f["rule_id"], "ruleIndex": index[f["rule_id"]], "level": _LEVELS[f["severity"]], "message": {"text": one_line(f["message"])}, "locations": [_location(f["relative_path"], f["range"])],
            **({"codeFlows": [{"threadFlows": [{"locations": steps}]}]} if steps else {}), "partialFingerprints": {"findingId/v1": f["id"]}, "properties": {"kinds": f["kinds"], "sourceId": f["source_id"]},
        })
    said = [{"level": _LEVELS[d["level"]], "message": {"text": one_line(d["message"])}, **({"locations": [_location(shortened(d["file"], root), d.get("range"))]} if d.get("file") else {})} for d in result["diagnostics"]]
    run = {
        "tool": {"driver": {"name": TOOL, "version": __version__, "informationUri": information_uri, "rules": [_descriptor(r) for r in rules]}}, "columnKind": "utf16CodeUnits", "originalUriBaseIds": {"%SRCROOT%": {"description": {"text": "the scanned folder"}}},
        "invocations": [{"executionSuccessful": not any(d["level"] == "error" for d in result["diagnostics"]), "toolExecutionNotifications": said}], "results": results,
    }
    return json.dumps({"$schema": SARIF_SCHEMA_URI, "version": SARIF_VERSION, "runs": [run]}, indent=2, ensure_ascii=False) + "\n"


def validate_sarif(text: str) -> list[str]:
    """What is wrong with a log; nothing is raised."""
    try:
        log = json.loads(text)
    except ValueError as e:
        return [f"not JSON: {e}"]
    if not isinstance(log, dict):
        return ["the log must be an object"]
    out = [] if log.get("version") == SARIF_VERSION else [f"version must be {SARIF_VERSION}"]
    runs = log.get("runs")
    if not isinstance(runs, list) or not runs:
        return [*out, "runs must be a list with a run"]
    for i, run in enumerate(runs):
        driver = run.get("tool", {}).get("driver", {}) if isinstance(run, dict) else {}
        if not driver.get("name"):
            out.append(f"runs[{i}].tool.driver.name is missing")
        ids = [r.get("id") for r in driver.get("rules", [])]
        if len(set(ids)) != len(ids):
            out.append(f"runs[{i}]: rule ids repeat")
        for j, r in enumerate(run.get("results", []) if isinstance(run, dict) else []):
            at = f"runs[{i}].results[{j}]"
            k = r.get("ruleIndex")
            if not isinstance(k, int) or not 0 <= k < len(ids) or ids[k] != r.get("ruleId"):
                out.append(f"{at}.ruleIndex doesn't point to {r.get('ruleId')}")
            if not r.get("message", {}).get("text"):
                out.append(f"{at}.message.text is missing")
            if r.get("level") not in ("none", "note", "warning", "error"):
                out.append(f"{at}.level is {r.get('level')}")
            flows = [x for c in r.get("codeFlows", []) for t in c.get("threadFlows", []) for x in t.get("locations", [])]
            if [x.get("executionOrder") for x in flows] != list(range(1, len(flows) + 1)):
                out.append(f"{at}: executionOrder must count from 1")
            for place in [*r.get("locations", []), *(x.get("location", {}) for x in flows)]:
                own = place.get("physicalLocation", {}).get("region")
                if own and (own["startLine"], own["startColumn"]) > (own["endLine"], own["endColumn"]):
                    out.append(f"{at}: a region ends before it begins")
    return out


# ---- Markdown and terminal ---------------------------------------------------------------------------------------


def _escaped(text: str) -> str:
    return re.sub(r"([\\`*_{}\[\]<>|#])", r"\\\1", one_line(text))


def _code(text: str) -> str:
    ticks = "`" * (max((len(m) for m in re.findall("`+", text)), default=0) + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{ticks}{pad}{one_line(text)}{pad}{ticks}"


def render_markdown(result: dict, max_findings: int | None = None) -> str:
    findings = result["findings"]
    shown = findings if max_findings is None else findings[:max_findings]
    out = ["# Findings", "", summary_line(findings), ""]
    if findings:
        out += ["| severity | findings |", "| --- | ---: |", *(f"| {s} | {n} |" for s, n in count_by_severity(findings).items()), ""]
        out += ["| # | severity | rule | place | kinds |", "| ---: | --- | --- | --- | --- |"]
        out += [f"| {i} | {f['severity']} | {_escaped(f['rule_id'])} | {_code(place(f))} | {', '.join(f['kinds'])} |" for i, f in enumerate(shown, 1)]
        if len(shown) < len(findings):
            out.append(f"\n{len(findings) - len(shown)} more not shown.")
        out.append("")
        for i, f in enumerate(shown, 1):
            out += [f"## {i}. {_escaped(f['rule_id'])}: {_code(place(f))}", "", _escaped(f["message"]), ""]
            if f["cwe"]:
                out += ["Weaknesses: " + ", ".join(f"[{c}]({cwe_url(c)})" if cwe_url(c) else _escaped(c) for c in f["cwe"]), ""]
            out += [f"{n}. **{s['role']}** {_code(s['label'])}, {_code(shortened(s['file'], result.get('root')))}:{s['range']['start']['line']}" + (f" ({_escaped(s['note'])})" if s.get("note") else "") for n, s in enumerate(f.get("proof") or [], 1)]
            if f["advice"]:
                out += ["", f"Advice: {_escaped(f['advice'])}"]
            out.append("")
    if result["diagnostics"]:
        out += ["## Diagnostics", "", *(f"- {d['level']}: {_escaped(d['message'])}" for d in result["diagnostics"]), ""]
    return "\n".join(out).rstrip("\n") + "\n"


def place(f: dict) -> str:
    return f"{f['relative_path']}:{f['range']['start']['line']}:{f['range']['start']['column']}"


def visible(text: str) -> str:
    """Control characters as escapes, so that a label can't drive the terminal."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", lambda m: f"\\x{ord(m[0]):02x}", text)


def width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def chosen_steps(proof: list[dict], most: int) -> list[dict | int]:
    """All steps if they fit; else the first ones, how many are left out, and the last."""
    if len(proof) <= most:
        return list(proof)
    if most <= 0:
        return []
    return [proof[-1]] if most == 1 else [*proof[: most - 1], len(proof) - most, proof[-1]]


_COLOURS = {"error": "\x1b[31m", "warning": "\x1b[33m", "note": "\x1b[36m"}


def render_pretty(result: dict, colour: bool = False, max_steps: int = 12) -> str:
    paint = lambda s, t: f"{_COLOURS[s]}{t}\x1b[0m" if colour else t
    out = []
    for severity in reversed(SEVERITIES):
        for f in (f for f in result["findings"] if f["severity"] == severity):
            out.append(f"{paint(severity, severity)}  {visible(f['rule_id'])}  {visible(place(f))}")
            out.append(f"  {visible(one_line(f['message']))} [{', '.join(f['kinds'])}]")
            steps = chosen_steps(f.get("proof") or [], max_steps)
            wide = max((width(visible(s["label"])) for s in steps if isinstance(s, dict)), default=0)
            for i, s in enumerate(steps):
                branch = "└─" if i == len(steps) - 1 else "├─"
                if isinstance(s, int):
                    out.append(f"  {branch} {s} omitted")
                else:
                    label = visible(s["label"])
                    out.append(f"  {branch} {s['role']:<9} {label}{' ' * (wide - width(label))}  {visible(shortened(s['file'], result.get('root')))}:{s['range']['start']['line']}" + (f"  ({visible(s['note'])})" if s.get("note") else ""))
            if f["advice"]:
                out.append(f"  advice: {visible(one_line(f['advice']))}")
            out.append("")
    out += [f"{d['level']}: {visible(one_line(d['message']))}" for d in result["diagnostics"] if d["level"] != "info"]
    out.append(summary_line(result["findings"]))
    return "\n".join(out) + "\n"


def create_reporter(name: str, **options) -> Callable[[dict], str]:
    known = {"json": render_json, "sarif": render_sarif, "markdown": render_markdown, "pretty": render_pretty}
    if name not in known:
        raise ValueError(f"unknown format {name}; known: {', '.join(known)}")
    return lambda result: known[name](result, **options)
