"""Rules meet nodes: one source, one sanitiser and all most specific sinks for a node. As tables, and as rows for graphs that fit the driver."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.frontend.expressions import Expression, parse_expression
from tidemark.operators import matching
from tidemark.plans.model import Graph, Occurrences, checkpointed

EXPRESSION = "node_id string, segments array<string>, identifier string, last string, is_call boolean, args array<string>"
HOPS = 8


def complete(rules: dict[str, list[dict]]) -> dict[str, list[dict]]:
    """Rules as both kernels take them: a sanitiser without kinds clears the whole vocabulary of sources and sinks."""
    vocabulary = sorted({k for r in (*rules["sources"], *rules["sinks"]) for k in r["kinds"]})
    return rules | {"sanitizers": [r if r["kinds"] else r | {"kinds": vocabulary} for r in rules["sanitizers"]]}


# ---- aliases -----------------------------------------------------------------------------------------------------


def through_aliases(e: Expression, aliases: dict[str, str]) -> Expression:
    """The expression with its root replaced by what it stands for, over eight hops at most."""
    segments, seen = e.segments, set()
    for _ in range(HOPS):
        root = segments[0] if segments else None
        if root is None or root in seen or root not in aliases:
            break
        seen.add(root)
        segments = aliases[root].split(".") + segments[1:]
    if segments is e.segments:
        return e
    return Expression(segments, segments[0] if len(segments) == 1 else None, e.is_call, e.args)


def node_expression(node: dict, aliases: dict[str, str] | None = None) -> Expression:
    found = parse_expression(node["text"] if node["text"] is not None else node["label"], node["label"], node["kind"] == "call")
    return through_aliases(found, aliases) if aliases else found


def expressions(nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row for each node. aliases (scope, name, chain) belong to the file before `::` of the function id; their chains are resolved before they meet nodes."""
    fields = pa.schema([("scope", pa.string()), ("node_id", pa.string()), ("segments", pa.list_(pa.string())), ("identifier", pa.string()), ("last", pa.string()), ("is_call", pa.bool_()), ("args", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n["id"], node_expression(n)) for n in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("scope"), *(pa.array(v, f.type) for f, v in zip(list(fields)[1:], ([i for i, _ in found], [e.segments for _, e in found], [e.identifier for _, e in found], [e.last for _, e in found], [e.is_call for _, e in found], [e.args for _, e in found]), strict=True))], schema=fields)

    read = nodes.select("id", "kind", "label", "text", F.substring_index("function_id", "::", 1).alias("scope")).mapInArrow(run, f"scope string, {EXPRESSION}")
    if aliases is None:
        return read.drop("scope")
    full = matching.resolved_aliases(checkpointed(aliases.select("scope", "name", "chain"))).select("scope", F.col("name").alias("root"), F.split("full", r"\.").alias("full"))
    on = read.withColumn("root", F.element_at("segments", 1)).join(full, ["scope", "root"], "left")
    segments = F.when(F.col("full").isNull(), F.col("segments")).otherwise(F.concat("full", F.slice("segments", F.lit(2), F.greatest(F.size("segments") - 1, F.lit(0)))))
    whole = on.withColumn("segments", segments)
    return whole.select("node_id", "segments", F.when(F.col("full").isNull(), F.col("identifier")).when(F.size("segments") == 1, F.element_at("segments", 1)).alias("identifier"), F.when(F.size("segments") > 0, F.element_at("segments", -1)).alias("last"), "is_call", "args")


def annotate(graph: Graph, rules: dict[str, DataFrame], read: DataFrame) -> Occurrences:
    """rules: tables of the catalogue; read: the nodes' expressions."""
    place = graph.nodes.select(F.col("id").alias("node_id"), "function_id", "range", "label").join(read.select("node_id", "is_call", "args"), "node_id")
    inside = graph.functions.select(F.col("id").alias("function_id"), F.col("name").alias("fn_name"), "class_name")
    # One walk for the three catalogues, and one join for what is asked of the nodes met.
    patterns = [rules[c].withColumns({"catalogue": F.lit(c), "allow_dynamic": F.lit(False)}) for c in ("sources", "sanitizers", "sinks")]
    every = checkpointed(matching.matched(read, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), patterns)))
    every = checkpointed(every.join(place, "node_id"))
    met = lambda c: every.where(F.col("catalogue") == c)
    hits = met("sources").join(inside, "function_id", "left")
    fits = matching.within_functions(F.col("within_functions"), F.col("function_id"), F.col("fn_name"), F.col("class_name"))
    sources = matching.most_specific(hits.where(fits)).select("node_id", F.col("id").alias("source_id"), F.array_sort("kinds").alias("kinds"), "function_id", "range", "label")
    cleared = matching.most_specific(met("sanitizers"))
    valid, reason = matching.validated(F.col("validation"), F.col("is_call"), F.col("args"))
    sanitizers = cleared.select("node_id", F.col("id").alias("sanitizer_id"), "kinds", valid.alias("valid"), reason.alias("invalid_reason"), "function_id", "range")
    sunk = matching.all_most_specific(met("sinks"))
    sinks = sunk.select("node_id", F.col("id").alias("sink_id"), "kinds", "severity", "message", "advice", "cwe", "function_id", "range", "label", matching.tainted_args(F.col("tainted_args"), F.col("args")).alias("tainted_args"))
    return Occurrences(sources, sanitizers, sinks)


# ---- rows --------------------------------------------------------------------------------------------------------


def pattern_matches(e: Expression, rule: dict) -> bool:
    """All given conditions hold; dots before a member mean that it ends the chain."""
    member, identifier, call = rule.get("member"), rule.get("identifier"), rule.get("call")
    if member is None and identifier is None and call is None:
        return False
    if member is not None:
        parts, chain = [p for p in member.split(".") if p], e.segments or []
        own = chain[len(chain) - len(parts) :] if member.startswith(".") else chain[: len(parts)]
        fits = lambda a, p: p == "*" or (a == p if a != "*" else bool(rule.get("allow_dynamic")))
        if not parts or len(chain) < len(parts) or not all(map(fits, own, parts)):
            return False
    if identifier is not None and e.identifier != identifier:
        return False
    return call is None or (e.is_call and (e.last or e.identifier) == call)


def rule_specificity(rule: dict) -> tuple[int, int, int, int]:
    member = rule.get("member") or ""
    return len([p for p in member.split(".") if p]), len(member), len(rule.get("identifier") or ""), len(rule.get("call") or "")


def best_matches(e: Expression, rules: list[dict]) -> list[dict]:
    """Rules tied at the highest specificity, in order of declaration."""
    found = [(rule_specificity(r), r) for r in rules if pattern_matches(e, r)]
    most = max((s for s, _ in found), default=None)
    return [r for s, r in found if s == most]


def _anchor(rule: dict) -> tuple[str, str | None]:
    """Where an expression must agree with a rule for it to match at all: its last or first segment, or the identifier."""
    member = [p for p in (rule.get("member") or "").split(".") if p]
    if rule.get("call") is not None:
        return "last", rule["call"]
    if rule.get("identifier") is not None:
        return "identifier", rule["identifier"]
    if not member:
        return "never", None
    return ("last", member[-1]) if rule["member"].startswith(".") else ("first", member[0])


class RuleIndex:
    """Rules by anchor, so that a node is held against a few of them."""

    def __init__(self, rules: list[dict]):
        self.by: dict[tuple[str, str | None], list[tuple[int, dict]]] = {}
        for k, r in enumerate(rules):
            where, text = _anchor(r)
            loose = text == "*" or r.get("allow_dynamic")
            self.by.setdefault((where, None if loose else text), []).append((k, r))

    def candidates(self, e: Expression) -> list[dict]:
        keys = {("last", e.last or e.identifier), ("last", None), ("identifier", e.identifier), ("first", e.segments[0] if e.segments else None), ("first", None)}
        return [r for _, r in sorted((x for k in keys for x in self.by.get(k, ())), key=lambda x: x[0])]


_LITERAL = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\$]|\\.|\$(?!\{))*`""", re.S)
_CONSTANT = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|true|false|null|undefined")


def invalid_reason(validation: str | None, e: Expression) -> str | None:
    if validation in (None, "none"):
        return None
    if not e.is_call:
        return "not a call"
    if not e.args:
        return "no arguments"
    bare = e.args[0].strip()
    for _ in range(8):
        if bare.startswith("(") and bare.endswith(")"):
            bare = bare[1:-1].strip()
    if _LITERAL.fullmatch(bare):
        return None
    if validation == "constant-argument":
        return None if _CONSTANT.fullmatch(bare) else "first argument is not constant"
    return "first argument is not a literal"


def annotate_rows(tables: dict[str, list[dict]], rules: dict[str, list[dict]]) -> dict[str, list[dict]]:
    """sources, sanitizers, sinks of a graph's rows, ordered by node and rule."""
    functions = {f["id"]: f for f in tables["functions"]}
    aliases: dict[str, dict[str, str]] = {}
    for a in sorted(tables.get("aliases", []), key=lambda a: a["seq"]):
        aliases.setdefault(a["scope"], {})[a["name"]] = a["chain"]
    rules = complete(rules)
    out: dict[str, list[dict]] = {"sources": [], "sanitizers": [], "sinks": []}
    index = {kind: RuleIndex(rules[kind]) for kind in out}
    for n in tables["nodes"]:
        e = node_expression(n, aliases.get(n["function_id"].split("::", 1)[0]))
        if e.empty:
            continue
        at = {"node_id": n["id"], "function_id": n["function_id"], "range": n["range"]}
        f = functions.get(n["function_id"], {})
        name, owner, parts = f.get("name"), f.get("class_name"), n["function_id"].split("::")
        names = {name, n["function_id"], f"{owner}.{name}", f"{owner}::{name}", *("::".join(parts[i:]) for i in range(len(parts)))}
        for r in best_matches(e, [r for r in index["sources"].candidates(e) if not r.get("within_functions") or names & set(r["within_functions"])])[:1]:
            out["sources"].append(at | {"source_id": r["id"], "kinds": sorted(r["kinds"]), "label": n["label"]})
        for r in best_matches(e, index["sanitizers"].candidates(e))[:1]:
            reason = invalid_reason(r.get("validation"), e)
            out["sanitizers"].append(at | {"sanitizer_id": r["id"], "kinds": r["kinds"], "valid": reason is None, "invalid_reason": reason})
        for r in best_matches(e, index["sinks"].candidates(e)):
            args = r["tainted_args"] if r.get("tainted_args") is not None else list(range(len(e.args)))
            out["sinks"].append(at | {"sink_id": r["id"], "kinds": r["kinds"], "severity": r["severity"], "message": r["message"], "advice": r.get("advice"), "cwe": r.get("cwe"), "label": n["label"], "tainted_args": args})
    for name, key in (("sources", "source_id"), ("sanitizers", "sanitizer_id"), ("sinks", "sink_id")):
        out[name].sort(key=lambda r, key=key: (r["node_id"], r[key]))
    return out
