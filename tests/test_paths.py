"""Paths by pointer doubling against following parents one by one, and a round's shuffle against its frontier."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import fixpoint
from tidemark.plans.fixpoint import paths, propagate
from tidemark.plans.model import Graph, Occurrences, SolveOptions, empty


def states_of(levels, wide, seed=2):
    r = random.Random(seed)
    return [(level, seq, r.randrange(wide) if level else None, f"n{level}.{seq}", [("z", ["sql"])] if r.random() < 0.2 else []) for level in range(levels) for seq in range(wide)]


@pytest.mark.parametrize(("levels", "wide"), [(1, 3), (2, 3), (7, 4), (1000, 2)])
def test_same_as_the_loop(spark, levels, wide):
    rows = states_of(levels, wide)
    at = {(level, seq): (parent, node, uses) for level, seq, parent, node, uses in rows}
    ends = [("a", levels - 1, 0), ("b", levels - 1, 0), ("c", levels // 2, 1), ("d", 0, 1)]

    def walked(level, seq):
        out = []
        while seq is not None:
            seq, node, uses = at[level, seq]
            out.append((node, uses))
            level -= 1
        return out[::-1]

    states = spark.createDataFrame(rows, "level int, seq long, parent long, node string, uses array<struct<sanitizer_id:string,kinds:array<string>>>")
    got = paths(states, spark.createDataFrame(ends, "id string, level int, seq long")).collect()
    assert {r["id"]: [(s["node"], [tuple(u) for u in s["uses"]]) for s in r["path"]] for r in got} == {i: walked(level, seq) for i, level, seq in ends}
    assert paths(states, spark.createDataFrame([], "id string, level int, seq long")).count() == 0


def star_and_chain(spark, arms, length):
    """One node with many moves, and a chain behind it."""
    ids = ["hub", *[f"a{i}" for i in range(arms)], *[f"c{i}" for i in range(length)]]
    place = "named_struct('start', named_struct('line', 1, 'column', 1), 'end', named_struct('line', 1, 'column', 2))"
    nodes = spark.createDataFrame([(i,) for i in ids], "id string").selectExpr("id", "0 seq", "'local' kind", "'f' function_id", f"{place} range", "'' label", "cast(null as array<string>) resolved_callees", "cast(null as string) text")
    pairs = [("hub", f"a{i}") for i in range(arms)] + [(f"a{i}", "c0") for i in range(arms)] + [(f"c{i}", f"c{i + 1}") for i in range(length - 1)] + [(f"c{length - 1}", "hub")]
    edges = spark.createDataFrame(pairs, "src string, dst string").selectExpr("src", "dst", "'assign' kind", "cast(null as int) arg_index")
    sources = nodes.where("id = 'hub'").selectExpr("id node_id", "'s' source_id", "array('sql', 'html') kinds", "function_id", "range", "label")
    graph = Graph(empty(spark, "functions"), nodes, edges, empty(spark, "call_sites"), empty(spark, "callback_links"))
    return graph, Occurrences(sources, empty(spark, "sanitizers"), empty(spark, "sinks"))


@pytest.mark.parametrize("ordered", [True, False])
def test_hubs_lie_in_several_buckets(spark, monkeypatch, ordered):
    monkeypatch.setattr(fixpoint, "HUB_MOVES", 10)
    graph, occurrences = star_and_chain(spark, 60, 3)
    solved = propagate(graph, occurrences, SolveOptions(ordered=ordered, max_call_depth=0))
    got = {(r["node"], r["level"]) for r in solved.states.collect()}
    assert got == {("hub", 0), *((f"a{i}", 1) for i in range(60)), *((f"c{i}", 2 + i) for i in range(3))} and solved.total == 64


def test_states_seen_are_not_shuffled(spark):
    """The plan of a round reads states and moves from their buckets: exchanges stand over the frontier and its arrivals only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    append = fixpoint.Store.append

    def noted(self, name, rows, by, level=None):
        plans.append((name, rows._jdf.queryExecution().executedPlan().toString()))
        return append(self, name, rows, by, level)

    fixpoint.Store.append, held = noted, append
    try:
        propagate(*star_and_chain(spark, 20, 4), SolveOptions(ordered=False, max_call_depth=0))
    finally:
        fixpoint.Store.append = held
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounds = [p for n, p in plans if n == "states"][1:]
    assert len(rounds) >= 5
    for p in rounds:
        # One exchange of the frontier to the moves' buckets, one of arrivals to those of the states.
        assert p.count("Exchange hashpartitioning") == 2 and p.count("Bucketed: true") >= 2, p
