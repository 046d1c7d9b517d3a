"""The summary of one function against that of the whole program."""

import pytest
from test_kernel import edge, node, random_tables, sink, source, tables

from tidemark.plans.local import LocalSolver
from tidemark.plans.model import SCHEMAS, Graph, Occurrences, SolveOptions, empty
from tidemark.plans.on_demand import summarise_function


def frames(spark, t):
    df = {k: spark.createDataFrame(v, SCHEMAS[k]) if v else empty(spark, k) for k, v in t.items()}
    return Graph(*[df[k] for k in ("functions", "nodes", "edges", "call_sites", "callback_links")]), Occurrences(df["sources"], df["sanitizers"], df["sinks"])


def told(row):
    return {"returns": set(row["tainted_return_from_params"]), "sinks": {(s["param_index"], s["sink_id"], s["sink_arg"]) for s in row["param_to_sink"]}}


@pytest.mark.parametrize(("seed", "functions"), [(0, ("a.ts::f0", "a.ts::f1")), (9, ("a.ts::f1",))])
def test_same_as_the_whole(spark, seed, functions):
    t = random_tables(seed)
    for f in functions:
        solver = LocalSolver(t, SolveOptions(seed_params=True, scope_function=f))
        solved = solver.run()
        want = solver.summaries(solved).get(f, {"returns": set(), "sinks": set()})
        summary, found, solution = summarise_function(*frames(spark, t), f)
        row = summary.collect()
        assert len(row) == 1 and row[0]["converged"]
        assert told(row[0]) == {"returns": set(want["returns"]), "sinks": {tuple(s[:3]) for s in want["sinks"]}}
        assert sorted(x["id"] for x in found.collect()) == sorted(x["id"] for x in solver.findings(solved) if x["function_id"] == f)
        assert solution.total <= len(solved["states"])


def test_cost_follows_the_slice(spark):
    """A long chain elsewhere isn't walked, a source that reaches the function is."""
    far = [node(f"x{i}", function="f") for i in range(40)]
    nodes = [*far, node("p", "param", "g", label="p"), node("r", "return", "g"), node("k", "call", "g"), node("s")]
    edges = [edge(f"x{i}", f"x{i + 1}") for i in range(39)] + [edge("p", "r", "return"), edge("p", "k", "argument", 0), edge("s", "p", "argument", 0), edge("s", "x0")]
    t = tables(nodes, edges, sources=[source("s"), source("x0", name="other")], sinks=[sink("k") | {"function_id": "a.ts::g"}])
    summary, found, solution = summarise_function(*frames(spark, t), "a.ts::g")
    assert told(summary.first()) == {"returns": {0}, "sinks": {(0, "snk", 0)}}
    assert {r["source_id"] for r in found.collect()} == {"src"} and solution.total <= 8
    summary, found, _ = summarise_function(*frames(spark, t), "no such function")
    assert told(summary.first()) == {"returns": set(), "sinks": set()} and found.count() == 0
