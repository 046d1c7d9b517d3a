"""The summary of one function, at a cost in proportion to what can reach it and not to the program.

What a summary says is observed within the function: at its sinks, its return nodes, and where its nodes return to callers. So first the nodes are found that have a way to one of these, backwards along
the moves, and then only they are solved, from the function's own parameters and the sources among them. Sanitisers, call depth and budget are those of the whole solution; as fewer states arrive, a function of which
the whole solution says that it met its limit may be complete here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.findings import deduped, observed, param_flows, raw_findings, summaries
from tidemark.plans.fixpoint import Solution, bind_params, moves, propagate
from tidemark.plans.model import Graph, Occurrences, SolveOptions, checkpointed
from tidemark.plans.store import Store


def sliced(ways: DataFrame, targets: DataFrame) -> DataFrame:
    """node: the targets (node) and every node from which ways (src, dst) lead to one. A round follows the nodes found in the one before; those found lie in buckets and aren't shuffled again."""
    store = Store(ways.sparkSession)
    store.append("ways", ways.select("src", "dst").distinct().repartition(store.buckets, "dst"), ("dst",))
    back, new, level = store.table("ways"), targets.select("node").distinct(), 0
    while store.append("found", new.repartition(store.buckets, "node").withColumn("level", F.lit(level)), ("node",), "level"):
        found = store.table("found")
        last = found.where(F.col("level") == level).select(F.col("node").alias("dst"))
        new = back.join(last, "dst").select(F.col("src").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        level += 1
    store.drop("ways")
    return store.released("found").select("node")


def slice_of(graph: Graph, sinks: DataFrame, function_id: str, options: SolveOptions) -> DataFrame:
    """node: what may reach a place where the function is observed."""
    own = graph.nodes.where(F.col("function_id") == function_id).select(F.col("id").alias("node"), "kind")
    away = graph.edges.where("kind = 'return'").join(graph.nodes.where(F.col("function_id") != function_id).select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("node"))
    places = own.where("kind = 'return'").select("node").unionByName(own.join(away, "node", "left_semi").select("node")).unionByName(own.join(sinks.select(F.col("node_id").alias("node")), "node", "left_semi").select("node"))
    return sliced(checkpointed(moves(graph, bind_params(graph), options).select("src", "dst")), checkpointed(places))


def summarise_function(graph: Graph, occurrences: Occurrences, function_id: str, known_sinks: DataFrame | None = None, options: SolveOptions = SolveOptions()) -> tuple[DataFrame, DataFrame, Solution]:
    """The function's summary (function_id, tainted_return_from_params, param_to_sink, converged; always one row), its findings, and the solution of its slice."""
    spark = graph.nodes.sparkSession
    options = SolveOptions(options.max_iterations, options.max_call_depth, options.dedupe, options.kinds, True, function_id, options.ordered, options.source_notes)
    solution = propagate(graph, occurrences, options, slice_of(graph, occurrences.sinks, function_id, options))
    met = checkpointed(observed(solution.states, occurrences.sinks, known_sinks, function_id))
    flows = param_flows(graph, solution, met).where(F.col("function_id") == function_id)
    found = raw_findings(graph, met)
    found = deduped(found) if options.dedupe else found
    named = spark.createDataFrame([(function_id,)], "function_id string")
    made = summaries(flows, solution.truncated).drop("converged").join(named, "function_id", "right")
    none = F.array().cast("array<int>"), F.array().cast("array<struct<param_index:int,sink_id:string,sink_arg:int>>")
    late = solution.truncated.withColumn("_late", F.lit(True))
    whole = made.join(late, "function_id", "left").select("function_id", F.coalesce("tainted_return_from_params", none[0]).alias("tainted_return_from_params"), F.coalesce("param_to_sink", none[1]).alias("param_to_sink"), F.col("_late").isNull().alias("converged"))
    return whole, found.where(F.col("function_id") == function_id), solution
