"""The tables' loop against the local twin, and small graphs with known answers."""

import random

import pytest

from tidemark.plans import findings as kernel
from tidemark.plans.local import LocalSolver, bind
from tidemark.plans.model import SCHEMAS, Graph, Occurrences, SolveOptions, empty


def at(line, column, end=None):
    return {"start": {"line": line, "column": column}, "end": {"line": line, "column": end or column + 3}}


def fn(name, params=()):
    return {"id": f"a.ts::{name}", "name": name, "class_name": None, "file": "/r/a.ts", "range": at(1, 1), "params": [{"name": p, "index": i, "optional": False, "rest": False, "destructured": None} for i, p in enumerate(params)], "body_range": at(1, 1), "callees": [], "analysable": True, "is_module_scope": False}


def node(id_, kind="local", function="f", place=None, label="x", callees=None):
    return {"id": id_, "seq": 0, "kind": kind, "function_id": f"a.ts::{function}", "range": place or at(1, 1), "label": label, "resolved_callees": callees, "text": None}


def edge(src, dst, kind="assign", index=None):
    return {"src": src, "dst": dst, "kind": kind, "arg_index": index}


def source(id_, kinds=("sql",), name="src"):
    return {"node_id": id_, "source_id": name, "kinds": list(kinds), "function_id": "a.ts::f", "range": at(1, 1), "label": ""}


def sink(id_, kinds=("sql",), args=(0,), place=None, name="snk"):
    return {"node_id": id_, "sink_id": name, "kinds": list(kinds), "severity": "error", "message": "m", "advice": None, "cwe": None, "function_id": "a.ts::f", "range": place or at(2, 1), "label": "", "tainted_args": list(args)}


def clear(id_, kinds=("sql",), valid=True):
    return {"node_id": id_, "sanitizer_id": "z", "kinds": list(kinds), "valid": valid, "invalid_reason": None, "function_id": "a.ts::f", "range": at(1, 1)}


def tables(nodes, edges, **more):
    return {"functions": [fn("f"), fn("g", ("p",))], "nodes": nodes, "edges": edges, "call_sites": [], "callback_links": [], "sources": [], "sanitizers": [], "sinks": []} | more


def local(t, **options):
    s = LocalSolver(t, SolveOptions(**options))
    solved = s.run()
    return s, solved, s.findings(solved)


CHAIN = [node("s"), node("m"), node("k", "call")]
LINKS = [edge("s", "m"), edge("m", "k", "argument", 0)]


def test_reaches():
    _, _, found = local(tables(CHAIN, LINKS, sources=[source("s")], sinks=[sink("k")]))
    assert [[p["role"] for p in f["proof"]] for f in found] == [["source", "propagate", "sink"]]


@pytest.mark.parametrize(("kinds", "args", "n"), [(("html",), (0,), 0), (("sql",), (1,), 0), (("sql",), (), 1), ((), (0,), 1)])
def test_kinds_and_arguments(kinds, args, n):
    assert len(local(tables(CHAIN, LINKS, sources=[source("s")], sinks=[sink("k", kinds, args)]))[2]) == n


@pytest.mark.parametrize(("clears", "valid", "kinds", "n"), [(("sql",), True, ("sql",), 0), (("sql",), False, ("sql",), 1), (("sql",), True, ("html", "sql"), 0), ((), True, ("html", "sql"), 0), (("html",), True, ("html", "sql"), 1)])
def test_sanitisers(clears, valid, kinds, n):
    assert len(local(tables(CHAIN, LINKS, sources=[source("s", kinds)], sinks=[sink("k")], sanitizers=[clear("m", clears, valid)]))[2]) == n


def test_raw_path_beside_a_clean_one():
    t = tables([*CHAIN, node("c")], [*LINKS, edge("s", "c"), edge("c", "k", "argument", 0)], sources=[source("s")], sinks=[sink("k")], sanitizers=[clear("c")])
    assert len(local(t)[2]) == 1


def test_dedupe_and_containment():
    nodes = [node("s"), node("k1", "property"), node("k2", "property")]
    t = tables(nodes, [edge("s", "k1"), edge("s", "k2")], sources=[source("s")], sinks=[sink("k1", place=at(2, 1, 20)), sink("k2", place=at(2, 5, 9))])
    assert len(local(t)[2]) == 1 and len(local(t, dedupe=False)[2]) == 2


def test_calls_recursion_and_budget():
    nodes = [node("s"), node("c", "call", callees=["a.ts::g"]), node("p", "param", "g", label="p"), node("r", "return", "g"), node("k", "call")]
    t = tables(nodes, [edge("s", "c", "argument", 0), edge("p", "r", "return"), edge("c", "k", "argument", 0)], sources=[source("s")], sinks=[sink("k")])
    s, solved, found = local(t, seed_params=True)
    assert len(found) == 1 and s.summaries(solved)["a.ts::g"]["returns"] == {0}
    _, solved, _ = local(t, max_iterations=1)
    assert "a.ts::f" in solved["truncated"]


def test_bind():
    params = [{"name": n, "index": i} for i, n in enumerate("abc")]
    assert bind(params, [{"id": "1", "label": "b"}, {"id": "2", "label": "x"}, {"id": "3", "label": "y"}]) == {1: "1", 0: "2", 2: "3"}


def random_tables(seed):
    r, kinds = random.Random(seed), ["html", "path", "sql"]
    fns = [fn(f"f{i}", [f"p{j}" for j in range(r.randint(0, 2))]) for i in range(3)]
    nodes = []
    for i in range(14):
        f, k = r.choice(fns), r.choice(["local", "call", "call", "param", "return", "property"])
        nodes.append(node(f"{f['id']}#{i}", k, f["name"], at(r.randint(1, 5), r.randint(1, 9)), r.choice(["p0", "p1", "x"]), [r.choice(fns)["id"]] if k == "call" and r.random() < 0.6 else None))
    ids = [n["id"] for n in nodes]
    edges = [edge(r.choice(ids), r.choice(ids), k, r.randint(0, 1) if k == "argument" else None) for k in (r.choice(["assign", "argument", "return", "property"]) for _ in range(22))]
    links = [{"call_node_id": r.choice(ids), "arg_node_id": r.choice(ids), "param_node_id": r.choice(ids), "return_node_id": None}]
    return {
        "functions": fns, "nodes": nodes, "edges": edges, "call_sites": [], "callback_links": links,
        "sources": [source(r.choice(ids), r.sample(kinds, r.randint(1, 3)), f"s{i}") for i in range(2)],
        "sanitizers": [clear(r.choice(ids), r.sample(kinds, r.randint(0, 2)), r.random() < 0.7) | {"sanitizer_id": f"z{i}"} for i in range(3)],
        "sinks": [sink(n["id"], r.sample(kinds, r.randint(0, 2)), r.choice([(), (0,), (1,)]), n["range"], f"k{i}") for i, n in enumerate(r.sample(nodes, 5))],
    }


@pytest.mark.parametrize(("seed", "depth", "budget"), [(0, 2, 50_000), (11, 1, 3)])
def test_tables_agree_with_local(spark, seed, depth, budget):
    t = random_tables(seed)
    options = SolveOptions(max_call_depth=depth, max_iterations=budget, seed_params=True)
    s = LocalSolver(t, options)
    solved = s.run()
    want = s.findings(solved)
    df = {k: spark.createDataFrame(v, SCHEMAS[k]) if v else empty(spark, k) for k, v in t.items()}
    got = kernel.analyse(Graph(*[df[k] for k in ("functions", "nodes", "edges", "call_sites", "callback_links")]), Occurrences(df["sources"], df["sanitizers"], df["sinks"]), None, options)
    key = lambda f: (f["id"], tuple(f["kinds"]), f["source_id"], tuple((p["node_id"], p["role"], p["note"]) for p in f["proof"]))
    assert [key(r.asDict(True)) for r in kernel.ordered(got.findings).collect()] == [key(f) for f in want]
    assert got.stats["iterations"] == len(solved["states"]) and got.truncated == solved["truncated"]
