"""Summaries of many functions: bindings by one shuffle, levels without order, budgets by groups; what they say is what the ordered solution says."""

import random

import pytest
from test_kernel import edge, fn, node, random_tables, source
from test_whole_tables import parts  # noqa: F401

from tidemark import table_queries
from tidemark.plans import findings as kernel, fixpoint
from tidemark.plans.fixpoint import bind_params, propagate, propagate_unordered
from tidemark.plans.model import SCHEMAS, Graph, Occurrences, SolveOptions, empty


def frames(spark, t):
    df = {k: spark.createDataFrame(v, SCHEMAS[k]) if v else empty(spark, k) for k, v in t.items()}
    return Graph(*[df[k] for k in ("functions", "nodes", "edges", "call_sites", "callback_links")]), Occurrences(df["sources"], df["sanitizers"], df["sinks"])


def bound_by_hand(params, nodes):
    """A node serves the first parameter that wants it, a parameter takes its first node, the rest meet in order."""
    first = {n["id"]: next((p["index"] for p in params if n["label"] == p["name"] or n["label"] in (p["destructured"] or [])), None) for n in nodes}
    out = {}
    for n in sorted(first):
        if first[n] is not None:
            out.setdefault(first[n], n)
    left = [p["index"] for p in params if p["index"] not in out], [n for n in sorted(first) if n not in out.values()]
    return out | dict(zip(*left))


def test_bindings_by_one_shuffle(spark):
    """Names, parts of destructured parameters, names that several have, too few and too many nodes."""
    r, t = random.Random(3), {"functions": [], "nodes": []}
    for i in range(60):
        f = fn(f"f{i}", [r.choice("abcd") for _ in range(r.randint(0, 4))])
        for p in f["params"]:
            p["destructured"] = r.choice([None, [], ["x"], ["x", "y", "a"]])
        t["functions"].append(f)
        t["nodes"] += [node(f"{f['id']}#{j}", r.choice(["param"] * 5 + ["local"]), f"f{i}", label=r.choice("abcdxyz")) for j in range(r.randint(0, 5))]
    graph, _ = frames(spark, t | {k: [] for k in ("edges", "call_sites", "callback_links", "sources", "sanitizers", "sinks")})
    bound = bind_params(graph)
    want = {(f["id"], i, n) for f in t["functions"] for i, n in bound_by_hand(f["params"], [n for n in t["nodes"] if n["function_id"] == f["id"] and n["kind"] == "param"]).items()}
    rows = [tuple(x) for x in bound.select("function_id", "index", "node_id").collect()]
    assert len(want) > 60 and sorted(rows) == sorted(want)
    assert bound._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_no_level_is_put_in_order(spark, parts, monkeypatch):  # noqa: F811
    orders, numbered = [], fixpoint._numbered
    monkeypatch.setattr(fixpoint, "_numbered", lambda rows, level, order, buckets: orders.append(order) or numbered(rows, level, order, buckets))
    assert table_queries.parameter_summaries(spark, parts).count() > 0
    assert len(orders) > 1 and not any(orders)


def chains(n, length):
    """n functions with a parameter whose token runs through a chain and out."""
    fns = [fn(f"f{i}", ["p"]) for i in range(n)]
    nodes = [node(f"{i}.{j}", "return" if j == length else "local" if j else "param", f"f{i}", label="p") for i in range(n) for j in range(length + 1)]
    edges = [edge(f"{i}.{j}", f"{i}.{j + 1}") for i in range(n) for j in range(length)]
    return {"functions": fns, "nodes": nodes, "edges": edges} | {k: [] for k in ("call_sites", "callback_links", "sources", "sanitizers", "sinks")}


def test_functions_are_not_counted_one_by_one(spark, monkeypatch):
    """Twelve functions of four states pass a limit of ten together, none alone."""
    made, init = [], fixpoint._Budget.__init__
    monkeypatch.setattr(fixpoint._Budget, "__init__", lambda self, limit: made.append(self) or init(self, limit))
    solved = propagate(*frames(spark, chains(12, 3)), SolveOptions(max_iterations=10, seed_params=True))
    assert solved.total == 48 and solved.truncated.count() == 0 and solved.states.where("not expanded").count() == 0
    assert made[0].grouped is not None and made[0].spent is None


def test_groups_that_pass_the_limit(spark, monkeypatch):
    """With eight groups in place of many, groups pass the limit and functions don't; a longer chain's function does."""
    monkeypatch.setattr(fixpoint, "GROUPS", 8)
    graph, none = frames(spark, chains(12, 3))
    assert propagate(graph, none, SolveOptions(max_iterations=6, seed_params=True)).truncated.count() == 0
    t, more = chains(12, 3), chains(13, 9)
    for k in ("functions", "nodes", "edges"):
        t[k] += [x for x in more[k] if str(x.get("id", x.get("src"))).startswith(("12.", "a.ts::f12"))]
    solved = propagate(*frames(spark, t), SolveOptions(max_iterations=6, seed_params=True))
    assert [r[0] for r in solved.truncated.collect()] == ["a.ts::f12"] and solved.total == 12 * 4 + 7


def same(spark, t, options):
    graph, occurrences = frames(spark, t)
    out = []
    for solve in (propagate, propagate_unordered):
        s = solve(graph, occurrences, options)
        states = sorted(tuple(map(str, r)) for r in s.states.select("node", "source_id", "kinds", "arg", "level", "symbolic", "expanded").collect())
        flows = [kernel.summaries(kernel.param_flows(graph, s, met), s.truncated) for met in (kernel.observed(s.states, occurrences.sinks),)]
        light = kernel.summarised(graph, s, kernel.observed(s.states, occurrences.sinks))
        said = [sorted(str(r) for r in x.select("function_id", "tainted_return_from_params", "param_to_sink", "converged").collect()) for x in (*flows, light)]
        assert said[0] == said[1]
        out.append((states, sorted(r[0] for r in s.truncated.collect()), sorted(r[0] for r in s.capped.collect()), said[0]))
    assert out[0] == out[1]
    return out[0]


@pytest.mark.parametrize(("calls", "budget"), [(True, 3), (False, 50_000), (False, 3)])
def test_same_without_order(spark, calls, budget):
    """With calls or a limit that is met, the order of arrival decides, and is kept."""
    t = random_tables(11)
    t["sources"].append(source(t["nodes"][0]["id"], ("sql",), "s9"))
    if not calls:
        t["callback_links"], t["nodes"] = [], [n | {"resolved_callees": None} for n in t["nodes"]]
    states, truncated, _, said = same(spark, t, SolveOptions(max_call_depth=1, max_iterations=budget, seed_params=True))
    assert states and said and bool(truncated) == (budget == 3)
