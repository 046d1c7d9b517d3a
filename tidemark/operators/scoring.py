"""Scoring findings against labelled lines."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: families in the order in which a finding's kinds are tried.
FAMILIES = ("sql", "html", "command", "path", "code", "nosql", "url")
TOLERANCE = 3


def family(kinds: Column) -> Column:
    found = F.lit("unknown")
    for f in reversed(FAMILIES):
        found = F.when(F.array_contains(kinds, f), f).otherwise(found)
    return found


def metrics(counts: DataFrame, *by: str) -> DataFrame:
    """counts (by..., tp, fp, fn) -> precision, recall, f1 to three places; nothing found or nothing to find counts as 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("p", p).withColumn("r", r).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    return out.select(*by, "tp", "fp", "fn", F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round("f", 3).alias("f1"))


def with_overall(counts: DataFrame, by: str) -> DataFrame:
    """Sums by group, and over all as group `overall`."""
    return counts.rollup(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn(by, F.coalesce(by, F.lit("overall")))


def _matched(cases: list[tuple], findings: list[tuple], tolerance: int) -> Iterator[tuple[int, int]]:
    """cases (case_ord, line, family) and findings (finding_ord, line, kinds) of a run: in case order, each takes the least finding_ord that is free, near enough and of its family."""
    free: dict[int, dict[tuple, deque]] = {}
    for ord_, line, kinds in sorted(findings, key=lambda f: f[0]):
        free.setdefault(line, {}).setdefault(kinds, deque()).append(ord_)
    for ord_, line, wanted in sorted(cases, key=lambda c: c[0]):
        # What is free on one line with the same kinds stands in a queue, so only heads are compared.
        heads = [(q[0], q) for at in range(line - tolerance, line + tolerance + 1) if at in free for kinds, q in free[at].items() if q and wanted in kinds]
        if heads:
            yield ord_, min(heads, key=lambda h: h[0])[1].popleft()


def greedy_matches(cases: DataFrame, findings: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """case_ord, finding_ord pairs: in case order, each takes the first free finding of its file whose kinds hold its family and whose line is near enough.

    Consumption depends on order, but lines further apart than the tolerance don't bear on each other: a file's lines, in order, fall into runs where a gap is wider. Files are dealt among tasks and sorted by line, and a task holds one run at a time.
    """
    none = F.lit(None)
    rows = cases.select("file", F.col("line").cast("long").alias("line"), F.col("case_ord").cast("long").alias("case_ord"), none.cast("long").alias("finding_ord"), "family", none.cast("array<string>").alias("kinds"), F.lit(True).alias("is_case"))
    found = findings.select("file", F.col("line").cast("long").alias("line"), none.cast("long").alias("case_ord"), F.col("finding_ord").cast("long").alias("finding_ord"), none.cast("string").alias("family"), "kinds", F.lit(False).alias("is_case"))
    dealt = rows.unionByName(found).where("line is not null").repartition("file").sortWithinPartitions("file", "line")
    schema = pa.schema([("case_ord", pa.int64()), ("finding_ord", pa.int64())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at_file, at_line = ([], []), None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for file, line, case, finding, wanted, kinds, is_case in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at_line is None or file != at_file or line - at_line > tolerance:
                    if held[0] and held[1]:
                        out += _matched(*held, tolerance)
                    held = ([], [])
                at_file, at_line = file, line
                if is_case:
                    held[0].append((case, line, wanted))
                else:
                    held[1].append((finding, line, tuple(kinds or ())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
        if held[0] and held[1] and (out := list(_matched(*held, tolerance))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return dealt.mapInArrow(match, "case_ord long, finding_ord long")


def near(cases: DataFrame, findings: DataFrame, tolerance: int = TOLERANCE, how: str = "left_semi") -> DataFrame:
    """cases (key, line) with (or without: left_anti) a finding of the same key in tolerance; lines meet by bucket, so no key's pairs are all made."""
    width = 2 * tolerance + 1
    left = cases.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("line") - tolerance) / width), F.floor((F.col("line") + tolerance) / width)))))
    right = findings.select("key", F.floor(F.col("line") / width).alias("bucket"), F.col("line").alias("found_line")).distinct()
    hit = left.join(right, ["key", "bucket"]).where(F.abs(F.col("line") - F.col("found_line")) <= tolerance).select(*cases.columns).distinct()
    return cases.join(hit, cases.columns, how)
