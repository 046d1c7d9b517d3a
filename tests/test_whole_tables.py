"""Registered queries take every row of their tables: keys beyond those of the smallest tables, against brute force."""

import pytest

from tidemark import source_queries, table_queries

KEYS = [0, 1, 2, 5, 199, 200, 202, 400, 402, 403, 19999]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, 5 + 10 * (k % 2)) for k in KEYS], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def test_every_part_is_a_file(spark, parts):
    rules = [rule for _, rule in source_queries.HANDLERS]
    found = {(r["relative_path"], r["rule_id"], r["line"]) for r in source_queries.source_findings(spark, parts).collect()}
    assert found == {(f"parts/p{k}.ts", rules[k % 6], 4) for k in KEYS if rules[k % 6]}
    functions = sorted(r["id"] for r in source_queries.source_functions(spark, parts).collect())
    assert functions == sorted(f"parts/p{k}.ts::{name}" for k in KEYS for name in ("wrap", "app.get~arg1", "<module>"))


def bound(k):
    """Parameters p0 to p2 to nodes n0 to n2 of part k: by label first, the rest in order."""
    labels = [f"p{(k + j) % 4}" if (k + j) % 4 < 3 else "other" for j in range(3)]
    by_name = {i: labels.index(f"p{i}") for i in range(3) if f"p{i}" in labels}
    left = [j for j in range(3) if j not in by_name.values()]
    return by_name | dict(zip([i for i in range(3) if i not in by_name], left))


def test_every_part_has_parameters(spark, parts):
    rows = table_queries.parameter_binding(spark, parts).collect()
    assert sorted(map(tuple, (r.asDict().values() for r in rows))) == sorted((k, i, f"n{j}") for k in KEYS for i, j in bound(k).items())


def test_every_part_has_a_summary(spark, parts):
    size = {k: 5 + 10 * (k % 2) for k in KEYS}
    got = {(r["function_id"], r["returned"], r["sinks"]) for r in table_queries.parameter_summaries(spark, parts).collect()}
    assert got == {(f"part.ts::f{k}", "0" if k % 2 == 0 else "", "1:sql-query:0" if size[k] < 10 else "") for k in KEYS if k % 2 == 0 or size[k] < 10}


LINES = [(o, n, "AR"[o % 2], float(q)) for o in range(14) for n, q in ((1, 4), (2, 1), (4, 3), (4 + 3 * (o % 2), 3), (5, 2))]


def kept_spans():
    """Ids of spans that no earlier span of their order and flag holds, the first of equal ones."""
    spans = {}
    for o, n, flag, q in LINES:
        a = n % 3 + 1
        spans.setdefault((o, flag), []).append((a, n, a + int(q) % 4))
    out = []
    for (o, flag), own in spans.items():
        first = {}
        for a, n, b in sorted(own):
            first.setdefault((a, b), (a, n, b))
        out += [(f"x{o}.{n}", flag) for a, n, b in first.values() if not any((x, m) < (a, n) and b <= y for x, m, y in first.values())]
    return out


def test_every_order_is_deduped(spark, tmp_path):
    lines = sorted(set(LINES))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, table_queries.containment_dedupe(spark, str(tmp_path)).select("id", "rule_id").collect()))
    assert got == sorted(kept_spans()) and len({i.split(".")[0] for i, _ in got}) == 14


def test_every_line_links_nations(spark, tmp_path):
    """A ring of four nations, of whose links only one is a first line of a large quantity, and a nation that none reaches."""
    tables = {
        "nation": ([(k, f"NATION_{k}", 0) for k in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(k, k) for k in range(5)], "s_suppkey long, s_nationkey int"),
        "customer": ([(k, k) for k in range(5)], "c_custkey long, c_nationkey int"),
        "orders": ([(k, (k + 1) % 4) for k in range(4)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(0, 0, 1, 50.0), (1, 1, 2, 50.0), (2, 2, 1, 3.0), (3, 3, 7, 1.0), (3, 4, 3, 2.0)], "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(map(tuple, table_queries.cyclic_reachability(spark, str(tmp_path)).collect()))
    assert got == sorted([(a, b) for a in range(4) for b in range(4) if a != b] + [(4, b) for b in range(4)])
