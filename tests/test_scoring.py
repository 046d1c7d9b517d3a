"""Greedy matching in runs of lines against the rule by itself."""

import contextlib
import io
import random

from tidemark.operators import scoring


def _by_rule(cases, findings, tolerance):
    free, out = sorted(findings, key=lambda f: f[1]), []
    for file, ord_, family, line in sorted(cases, key=lambda c: c[1]):
        hit = next((f for f in free if f[0] == file and family in f[2] and abs(f[3] - line) <= tolerance), None)
        if hit:
            free.remove(hit)
            out.append((ord_, hit[1]))
    return sorted(out)


def test_greedy_matches_in_runs(spark):
    draw = random.Random(3)
    file = lambda: draw.choice(["a", "b", None])
    cases = [(file(), k, draw.choice(["sql", "html", "path"]), draw.randrange(120)) for k in range(150)]
    findings = [(file(), 1000 - k, draw.choice([["sql"], ["html", "sql"], ["html"], [], None]) or [], draw.randrange(120)) for k in range(150)]
    made = scoring.greedy_matches(spark.createDataFrame(cases, "file string, case_ord long, family string, line long"), spark.createDataFrame(findings, "file string, finding_ord long, kinds array<string>, line long"))
    assert sorted(map(tuple, made.collect())) == _by_rule(cases, findings, scoring.TOLERANCE)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        made.explain()
    assert "CoGroups" not in plan.getvalue()  # a file is no group of its own that Python gets whole
