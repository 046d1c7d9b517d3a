"""The trie join against holding every rule against every expression."""

import random

from pyspark.sql import functions as F

from tidemark.operators import matching, trie

RULE = "ord int, id string, member string, identifier string, call string, allow_dynamic boolean"
EXPRESSION = "node_id string, segments array<string>, identifier string, last string, is_call boolean"


def rules_of(n, seed=3):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    rows = []
    for k in range(n):
        parts = [r.choice(["*", *names, *names]) for _ in range(r.choice([1, 1, 2, 2, 3, 4, 6]))]
        member = r.choice(["", "."]) + ".".join(parts) if r.random() < 0.8 else None
        rows.append((k, f"r{k % (n - n // 9)}", member, r.choice(names) if r.random() < 0.2 else None, r.choice(names) if r.random() < 0.3 else None, r.choice([True, False, None])))
    return [*rows, (n, "none", None, None, None, False), (n + 1, "dots", "..", "n1", None, True), (n + 2, "any", "*", None, None, False), (n + 3, "end", ".*", None, "n2", True)]


def expressions_of(n, seed=4):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        segments = [r.choice(["*", *[f"n{i}" for i in range(60)]]) for _ in range(r.choice([1, 1, 2, 3, 4, 5, 8]))]
        rows.append((f"e{k}", segments, segments[0] if len(segments) == 1 else None, segments[-1], r.random() < 0.6))
    return [*rows, ("none", None, None, None, True), ("empty", [], None, None, None), ("name", None, "n3", None, True), ("name2", None, "n3", None, None)]


def test_same_as_every_pair(spark):
    rules = spark.createDataFrame(rules_of(10_000), RULE)
    expressions = spark.createDataFrame(expressions_of(150), EXPRESSION)
    pairs = expressions.alias("e").join(F.broadcast(rules.alias("r")), matching.rule_matches()).select("e.node_id", "r.ord", "r.id")
    want = sorted(map(tuple, pairs.collect()))
    got = matching.matched(expressions, rules)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("node_id", "ord", "id").collect())) == want and len(want) > 5000


def test_shuffled_when_too_large_to_broadcast(spark, monkeypatch):
    rules, expressions = spark.createDataFrame(rules_of(300), RULE), spark.createDataFrame(expressions_of(100), EXPRESSION)
    few = sorted(map(tuple, matching.matched(expressions, rules).select("node_id", "ord").collect()))
    monkeypatch.setattr(trie, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, matching.matched(expressions, rules).select("node_id", "ord").collect())) == few
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_rules_and_no_expressions(spark):
    rules, expressions = spark.createDataFrame(rules_of(20), RULE), spark.createDataFrame(expressions_of(5), EXPRESSION)
    assert matching.matched(expressions, rules.limit(0)).count() == 0
    assert matching.matched(expressions.limit(0), rules).count() == 0
    assert matching.matched(expressions, rules.where("id = 'none'")).columns == ["node_id", *rules.columns, "spec"]
