"""The loop lets go of what its plans left in the driver, round by round."""

from tidemark.plans.fixpoint import propagate
from tidemark.plans.model import Graph, Occurrences, SolveOptions, empty


def _collections(spark) -> int:
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_each_round_lets_go(spark):
    place = "named_struct('start', named_struct('line', 1, 'column', 1), 'end', named_struct('line', 1, 'column', 1))"
    nodes = spark.range(4).selectExpr("cast(id as string) id", "0 seq", "'local' kind", "'f' function_id", f"{place} range", "'' label", "cast(null as array<string>) resolved_callees", "cast(null as string) text")
    edges = spark.range(3).selectExpr("cast(id as string) src", "cast(id + 1 as string) dst", "'assign' kind", "cast(null as int) arg_index")
    sources = spark.range(1).selectExpr("'0' node_id", "'s' source_id", "array('url') kinds", "'f' function_id", f"{place} range", "'' label")
    before = _collections(spark)
    solved = propagate(Graph(empty(spark, "functions"), nodes, edges, empty(spark, "call_sites"), empty(spark, "callback_links")), Occurrences(sources, empty(spark, "sanitizers"), empty(spark, "sinks")), SolveOptions())
    assert _collections(spark) - before >= solved.rounds == 4
    assert solved.states.count() == 4
