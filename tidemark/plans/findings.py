"""What a solution means: findings with proofs, parameter summaries, statistics and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tags import intersected
from tidemark.functions.text import finding_id
from tidemark.operators.running import running
from tidemark.plans.fixpoint import NO_ARG, Solution, own_tokens, paths, propagate
from tidemark.plans.model import Graph, Occurrences, SolveOptions, checkpointed, small

#: The order of findings; discovery (level, seq, rule) settles ties.
ORDER = ["file", "range.start.line", "range.start.column", "rule_id", "source_id", "level", "seq"]


def argument_allowed(node_kind: Column, tainted_args: Column, arg: Column) -> Column:
    """Other nodes than calls always pass, an empty list passes; else the position must be known and listed."""
    listed = F.coalesce(tainted_args, F.array().cast("array<int>"))
    return (node_kind != "call") | (F.size(listed) == 0) | F.array_contains(listed, arg)


def observed(states: DataFrame, sinks: DataFrame, known_sinks: DataFrame | None = None, scope_function: str | None = None) -> DataFrame:
    """States at sinks whose kinds and argument position fit, with the sink's columns; kinds are what both share."""
    own = sinks if known_sinks is None else sinks.join(known_sinks.select(F.col("id").alias("sink_id")), "sink_id", "left_semi")
    own = own.select(F.col("node_id").alias("node"), "sink_id", F.col("kinds").alias("sink_kinds"), "severity", "message", "advice", "cwe", F.col("function_id").alias("sink_function"), "range", F.col("label").alias("sink_label"), "tainted_args")
    met = states.join(own, "node")
    if scope_function is not None:
        met = met.where(F.col("function_id") == scope_function)
    met = met.withColumn("kinds", intersected(F.col("kinds"), F.col("sink_kinds"))).where(F.size("kinds") > 0)
    return met.where(argument_allowed(F.col("node_kind"), F.col("tainted_args"), F.col("arg")))


def relative_path(function_id: Column) -> Column:
    """What stands before the first `::` of a function id."""
    return F.substring_index(function_id, "::", 1)


def raw_findings(graph: Graph, met: DataFrame) -> DataFrame:
    """One row for each real state that meets a sink; symbolic states make summaries instead."""
    real = met.where("not symbolic")
    files = small(graph.functions.select(F.col("id").alias("fid"), F.col("file").alias("fn_file")))
    owned = real.join(files, real["sink_function"] == files["fid"], "left").withColumn("function_id", F.when(F.col("fid").isNotNull(), F.col("sink_function")).otherwise(F.col("function_id"))).drop("fid", "fn_file")
    rel = relative_path(F.col("function_id"))
    placed = owned.join(files, owned["function_id"] == files["fid"], "left").withColumn("relative_path", rel).withColumn("file", F.coalesce("fn_file", "relative_path"))
    return placed.select(
        finding_id(F.col("sink_id"), F.col("relative_path"), F.col("range.start.line"), F.col("range.start.column")).alias("id"),
        F.col("sink_id").alias("rule_id"), "severity", "message", "advice", "cwe", "kinds", "source_id", "sink_id", "file", "relative_path", "range", "function_id", "level", "seq",
    )


def deduped(findings: DataFrame) -> DataFrame:
    """First of each rule, file and range; then none that lies within a range of an earlier one of the same rule, file and first line.

    Among ranges that begin on one line, in order, an earlier one begins first; so one that holds a later one is there if the furthest end so far isn't short of
    the later one's end. Containment is transitive, so any earlier range stands for any kept earlier one. Findings without a range have only themselves to repeat.

    The first of a range is a minimum, combined before it is sent; the furthest end runs in two levels, so neither a sink that everything reaches nor a file of one line is one task's work.
    """
    line, place = ["rule_id", "file", "_line"], ["source_id", "level", "seq"]
    rest = [c for c in findings.columns if c not in (*line, *place, "range")]
    first = findings.withColumn("_line", F.col("range.start.line")).groupBy(*line, "range").agg(F.min(F.struct(*place, *rest)).alias("x")).select(*line, "range", "x.*").withColumn("_column", F.col("range.start.column"))
    end = F.struct(F.col("range.end.line").alias("line"), F.col("range.end.column").alias("column"))
    none = F.struct(F.lit(-1).alias("line"), F.lit(-1).alias("column"))
    marked = running(first, line, ["_column", *place], {"_far": (F.max, F.when(F.col("range").isNotNull(), end))}, inclusive=False).withColumn("_far", F.coalesce("_far", none))
    # Those at one place in the order count as none before another.
    marked = marked.withColumn("_far", F.min("_far").over(Window.partitionBy(*line, "_column", *place)))
    return marked.where(F.col("range").isNull() | (F.col("_far") < end)).select(*findings.columns)


def with_proofs(graph: Graph, states: DataFrame, findings: DataFrame, notes: dict[str, str] | None = None) -> DataFrame:
    """findings with proof: array of node_id, file, range, label, role, note. Neighbouring repeats of a node fold into one step; a path of one node is both source and sink."""
    # A path is one row's array: its repeats and ends are known before its steps are rows.
    folded = F.filter("path", lambda s, i: (i == 0) | (s["node"] != F.get("path", i - 1)["node"]))
    found = checkpointed(paths(states, findings).select("id", "level", "seq", "source_id", folded.alias("path")))
    steps = found.select("id", "level", "seq", "source_id", (F.size("path") - 1).alias("end"), F.posexplode("path").alias("pos", "step"))
    placed = steps.select("id", "level", "seq", "source_id", "pos", "step.node", "step.uses", (F.col("pos") == 0).alias("first"), (F.col("pos") == F.col("end")).alias("last"))
    files = graph.functions.select(F.col("id").alias("function_id"), F.col("file").alias("fn_file"))
    named = placed.join(graph.nodes.select(F.col("id").alias("node"), "range", "label", "function_id"), "node").join(files, "function_id", "left").withColumn("file", F.coalesce("fn_file", relative_path(F.col("function_id"))))
    cleared = F.concat(F.lit("sanitizer "), F.array_join(F.array_sort(F.array_distinct(F.transform("uses", lambda u: u["sanitizer_id"]))), ", "), F.lit(" clears "), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("uses", lambda u: u["kinds"])))), ", "))
    note = F.when(F.size("uses") > 0, cleared)
    described = note
    if notes:
        described = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in notes.items() for x in kv]), F.col("source_id")), note)
    step = lambda role, n: F.struct(F.col("pos"), F.lit(1 if role == "sink" else 0).alias("half"), F.col("node").alias("node_id"), "file", "range", "label", F.lit(role).alias("role"), n.alias("note"))
    middle = F.when(note.isNotNull(), step("sanitize", note)).otherwise(step("propagate", note))
    made = F.when(F.col("first") & F.col("last"), F.array(step("source", described), step("sink", note))).when(F.col("first"), F.array(step("source", described))).when(F.col("last"), F.array(step("sink", note))).otherwise(F.array(middle))
    proofs = named.select("id", "level", "seq", F.explode(made).alias("s")).groupBy("id", "level", "seq").agg(F.array_sort(F.collect_list("s")).alias("s"))
    proof = F.transform("s", lambda s: F.struct(*[s[c].alias(c) for c in ("node_id", "file", "range", "label", "role", "note")]))
    return findings.join(proofs.select("id", "level", "seq", proof.alias("proof")), ["id", "level", "seq"], "left")


def _flows(graph: Graph, states: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (function_id, param_index, node) and sinks (function_id, param_index, sink_id, sink_arg, range), repeats included."""
    own = own_tokens(states)
    ends = graph.nodes.select(F.col("id").alias("dst"), F.col("function_id").alias("f1"))
    outward = graph.edges.where("kind = 'return'").select(F.col("src").alias("node"), "dst").join(ends, "dst").select("node", "f1")
    returns = own.where("node_kind = 'return'").select("function_id", "param_index", "node").unionByName(own.join(outward, "node").where("function_id <> f1").select("function_id", "param_index", "node"))
    return returns, own_tokens(met).select("function_id", "param_index", "sink_id", F.when(F.col("arg") == NO_ARG, -1).otherwise(F.col("arg")).alias("sink_arg"), "range")


def param_flows(graph: Graph, solution: Solution, met: DataFrame) -> DataFrame:
    """kind (return or sink), function_id, param_index, sink_id, sink_arg, range: what symbolic parameter tokens reach in their own function."""
    returns, reached = _flows(graph, solution.states, met)
    ranges, none = graph.nodes.select(F.col("id").alias("node"), "range"), F.lit(None)
    returns = returns.distinct().join(ranges, "node").select(F.lit("return").alias("kind"), "function_id", "param_index", none.cast("string").alias("sink_id"), none.cast("int").alias("sink_arg"), "range")
    return returns.unionByName(reached.dropDuplicates().select(F.lit("sink").alias("kind"), "*"))


def summarised(graph: Graph, solution: Solution, met: DataFrame) -> DataFrame:
    """The summaries of param_flows, without the ranges and their join."""
    returns, reached = _flows(graph, solution.states, met)
    none = F.lit(None)
    returns = returns.select(F.lit("return").alias("kind"), "function_id", "param_index", none.cast("string").alias("sink_id"), none.cast("int").alias("sink_arg"))
    return summaries(returns.unionByName(reached.drop("range").select(F.lit("sink").alias("kind"), "*")), solution.truncated)


def summaries(flows: DataFrame, truncated: DataFrame) -> DataFrame:
    """function_id, tainted_return_from_params, param_to_sink, converged; one row for each function with a flow."""
    grouped = flows.groupBy("function_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "return", F.col("param_index")))).alias("tainted_return_from_params"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "sink", F.struct("param_index", "sink_id", "sink_arg")))).alias("param_to_sink"),
    )
    return grouped.join(truncated.withColumn("_late", F.lit(True)), "function_id", "left").withColumn("converged", F.col("_late").isNull()).drop("_late")


@dataclass
class Result:
    """Tables, and what a report takes from them, which is collected when it is asked for."""

    graph: Graph
    options: SolveOptions
    solution: Solution
    findings: DataFrame
    states: DataFrame
    flows: DataFrame
    late: DataFrame  # function_id of truncated functions
    said: DataFrame  # level, message, function_id: in which ways the analysis is incomplete

    @cached_property
    def truncated(self) -> list[str]:
        return [r[0] for r in self.late.orderBy("function_id").collect()]

    @cached_property
    def diagnostics(self) -> list[tuple[str, str, str | None]]:
        return [(r["level"], r["message"], r["function_id"]) for r in self.said.orderBy("phase", "order").collect()]

    @cached_property
    def stats(self) -> dict:
        return {
            "functions": self.graph.functions.where("not coalesce(is_module_scope, false)").count(), "nodes": self.graph.nodes.count(), "edges": self.graph.edges.count(),
            "iterations": self.solution.total, "truncated": self.truncated, "rounds": self.solution.rounds,
        }


def incomplete(graph: Graph, solution: Solution, options: SolveOptions) -> DataFrame:
    """phase, order, level, message, function_id: a row for each function that met a limit, and for each callback that is wired to a parameter the graph doesn't have."""
    f = F.col("function_id")
    row = lambda df, phase, level, message, order, owner: df.select(F.lit(phase).alias("phase"), order.alias("order"), F.lit(level).alias("level"), F.concat(*message).alias("message"), owner.alias("function_id"))
    out = row(solution.truncated, 0, "warning", (F.lit("analysis of "), f, F.lit(f" stopped at its limit of {options.max_iterations} states")), f, f)
    out = out.unionByName(row(solution.capped, 1, "info", (F.lit("recursion into "), f, F.lit(f" stopped at depth {options.max_call_depth}")), f, f))
    params = graph.nodes.select(F.col("id").alias("param_node_id"))
    dangling = graph.callback_links.where("param_node_id is not null").join(params, "param_node_id", "left_anti").select("call_node_id", "param_node_id").distinct()
    wired = (F.lit("callback wiring of "), F.col("call_node_id"), F.lit(" names parameter node "), F.col("param_node_id"), F.lit(", which the graph doesn't have"))
    return out.unionByName(row(dangling, 2, "warning", wired, F.concat("call_node_id", F.lit(" "), "param_node_id"), F.lit(None).cast("string")))


def analyse(graph: Graph, occurrences: Occurrences, known_sinks: DataFrame | None = None, options: SolveOptions = SolveOptions(), proofs: bool = True) -> Result:
    """Solve and finish: kinds allow-list, order, dedupe, proofs. The order is that of ORDER; sort by it when collecting. Nothing is collected here."""
    solution = propagate(graph, occurrences, options)
    states = solution.states
    met = checkpointed(observed(states, occurrences.sinks, known_sinks, options.scope_function))
    found = raw_findings(graph, met)
    if options.kinds:
        found = found.where(F.arrays_overlap("kinds", F.array(*map(F.lit, options.kinds))))
    found = deduped(found) if options.dedupe else found
    found = checkpointed(found)
    if proofs:
        found = checkpointed(with_proofs(graph, states, found, options.source_notes))
    return Result(graph, options, solution, found, states, param_flows(graph, solution, met), solution.truncated, incomplete(graph, solution, options))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*ORDER)
