"""Sets of sources against states one by one, and how many rows they take."""

import random

import pytest
from test_kernel import random_tables, source

from tidemark import table_queries
from tidemark.plans import fixpoint, findings, reach as plan
from tidemark.plans.fixpoint import propagate
from tidemark.plans.model import SCHEMAS, Graph, Occurrences, SolveOptions, empty
from tidemark.plans.reach import reach


@pytest.mark.parametrize(("seed", "hub", "names"), [(1, 1_000_000, 100_000), (4, 2, 20)])
def test_same_states_at_the_same_levels(spark, monkeypatch, seed, hub, names):
    """With 150 sources there are three words, or more where several tasks number them."""
    monkeypatch.setattr(fixpoint, "HUB_MOVES", hub)
    monkeypatch.setattr(plan, "NAMES", names)
    t, r = random_tables(seed), random.Random(seed)
    ids = [n["id"] for n in t["nodes"]]
    t["sources"] = [source(r.choice(ids), r.sample(["html", "path", "sql"], r.randint(0, 3)), f"s{i % 140}") for i in range(150)]
    df = {k: spark.createDataFrame(v, SCHEMAS[k]) if v else empty(spark, k) for k, v in t.items()}
    graph, occurrences = Graph(*[df[k] for k in ("functions", "nodes", "edges", "call_sites", "callback_links")]), Occurrences(df["sources"], df["sanitizers"], df["sinks"])
    columns = ("node", "source_id", "kinds", "arg", "level")
    rows = lambda states: sorted(tuple(map(str, x)) for x in states.select(*columns).collect())
    flow = reach(graph, occurrences)
    want = propagate(graph, occurrences, SolveOptions(max_iterations=1 << 40, max_call_depth=0, ordered=False)).states
    got = rows(flow.apart(flow.sets))
    assert got == rows(want) and len(got) > 150


def test_sources_share_rows(spark, monkeypatch):
    """The flow graph's loop writes a row for a node's sources together, where it once wrote one for each."""
    written = []
    append = fixpoint.Store.append

    def noted(self, name, rows, by, level=None):
        written.append((name, append(self, name, rows, by, level)))
        return written[-1][1]

    monkeypatch.setattr(fixpoint.Store, "append", noted)
    states = table_queries.taint_states(spark, "/root/testdata/sf0.001").count()
    assert 0 < 3 * sum(n for name, n in written if name in ("sets", "states")) < 2 * states


def test_findings_of_few_functions_are_not_dealt_by_function(spark):
    """Every sink lies in one of two functions: their files are broadcast, else two tasks would have all findings."""
    found = table_queries._findings(spark, "/root/testdata/sf0.001")
    plan_text = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sink_function" not in plan_text and "hashpartitioning(function_id" not in plan_text
    assert findings.deduped(found).count() > 0
