"""What an analysis asks of the driver: tables that are read from files are not gathered in it, and plans are few and small."""

import pytest

from tidemark.engine import analyse_files, scan_source
from tidemark.operators import matching
from tidemark.plans import fixpoint
from tidemark.plans.findings import with_proofs
from tidemark.plans.fixpoint import propagate
from tidemark.plans.model import Graph, Occurrences, SolveOptions, empty
from tidemark.plans.store import Store
from tidemark.sources.config import Config
from tidemark.sources.discovery import graph_tables


def test_graph_tables_are_not_broadcast(spark):
    """Files of a few kB are below Spark's bound for broadcasts, whatever their rows take; the graph's tables and the loop's are dealt out all the same."""
    files = spark.createDataFrame([("a.ts", "app.get('/a', (req, res) => {\n  const v = req.query.id;\n  exec(v);\n});\n")], "relative_path string, text string")
    graph, _, _ = graph_tables(files)
    own = graph.nodes.selectExpr("id as dst", "function_id")
    store = Store(spark)
    store.append("ways", graph.edges.repartition(store.buckets, "dst"), ("dst",))
    joins = [graph.edges.join(own, "dst"), graph.nodes.join(graph.functions.selectExpr("id as function_id", "file"), "function_id", "left"), own.join(store.table("ways"), "dst", "left_anti"), own.join(store.released("ways"), "dst")]
    for join in joins:
        assert "Broadcast" not in join._jdf.queryExecution().executedPlan().toString()
    assert joins[0].count() == graph.edges.count() > 0 and joins[2].count() > 0


def resolved(aliases, hops=8):
    """By the definition, one alias at a time."""
    step, out = {(s, n): c for s, n, c in aliases}, []
    for scope, name, full in aliases:
        seen = [name]
        for _ in range(hops - 1):
            root = full.split(".")[0]
            if (scope, root) not in step or root in seen:
                break
            seen.append(root)
            full = step[scope, root] + full[len(root) :]
        out.append((scope, name, full))
    return sorted(out)


CHAINS = [("a", "x", "y.p"), ("a", "y", "z"), ("a", "z", "m.q"), ("b", "y", "other"), ("c", "u", "w.k"), ("c", "w", "u.l"), ("d", "s", "s.t"), *[("e", f"n{i}", f"n{i + 1}.s{i}") for i in range(12)]]


@pytest.mark.parametrize(("aliases", "plans"), [([("a", "cp", "child_process"), ("b", "cp", "cp.x"), ("c", "f", "fs.read")], 1), (CHAINS, 7), ([], 1)])
def test_aliases_go_on_while_they_stand_for_one(spark, monkeypatch, aliases, plans):
    """Chains that stand for no alias are one plan with one join; others are hopped one by one."""
    made, kept = [], matching.checkpointed
    monkeypatch.setattr(matching, "checkpointed", lambda df: made.append(df) or kept(df))
    found = matching.resolved_aliases(spark.createDataFrame(aliases, "scope string, name string, chain string"))
    assert sorted(map(tuple, found.collect())) == resolved(aliases) and len(made) == plans


def test_groups_are_not_counted_again(spark, monkeypatch):
    """All states together pass the limit at level 3; what comes after couldn't bring the largest group there."""
    made, init = [], fixpoint._Budget.__init__
    monkeypatch.setattr(fixpoint._Budget, "__init__", lambda self, limit: made.append(self) or init(self, limit))
    place = "named_struct('start', named_struct('line', 1, 'column', 1), 'end', named_struct('line', 1, 'column', 1))"
    each = spark.range(30).selectExpr("concat('f', id) f")
    nodes = each.join(spark.range(6).selectExpr("id j")).selectExpr("concat(f, '.', j) id", "0 seq", "'local' kind", "f function_id", f"{place} range", "'' label", "cast(null as array<string>) resolved_callees", "cast(null as string) text")
    edges = each.join(spark.range(5).selectExpr("id j")).selectExpr("concat(f, '.', j) src", "concat(f, '.', j + 1) dst", "'assign' kind", "cast(null as int) arg_index")
    sources = each.selectExpr("concat(f, '.0') node_id", "'s' source_id", "array('url') kinds", "f function_id", f"{place} range", "'' label")
    solved = propagate(Graph(empty(spark, "functions"), nodes, edges, empty(spark, "call_sites"), empty(spark, "callback_links")), Occurrences(sources, empty(spark, "sanitizers"), empty(spark, "sinks")), SolveOptions(max_iterations=100))
    assert solved.total == 180 and solved.truncated.isEmpty() and solved.rounds == 6
    assert made[0].level == 3 and made[0].total == 120


def test_proofs_are_made_within_their_rows(spark):
    """A path's repeats and ends are found in its array, so that steps are put together by one grouping and no window."""
    files = spark.createDataFrame([("a.ts", "app.get('/a', (req, res) => {\n  const v = wrap(req.query.id);\n  exec(v);\n});\nfunction wrap(x) { return 'cat ' + x; }\n")], "relative_path string, text string")
    result, _ = analyse_files(spark, files, Config(), proofs=False)
    proved = with_proofs(result.graph, result.states, result.findings)
    assert "Window" not in proved._jdf.queryExecution().executedPlan().toString()
    assert [[(s["role"], s["label"]) for s in r["proof"]] for r in proved.collect()] == [[(s["role"], s["label"]) for s in f["proof"]] for f in scan_source(files.first()["text"], "a.ts")["findings"]] != []
