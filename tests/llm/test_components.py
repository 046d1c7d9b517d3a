"""Connected components over graphs of any shape and order of ids."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed
from tidemark.llm.components import components
from tidemark.plans.model import estimated_bits


def least_reached(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(near):
        todo = [] if x in out else [x]
        while todo:
            if (y := todo.pop()) not in out:
                out[y] = x
                todo += near[y]
    return {n: c for n, c in out.items() if any(m != n for m in near[n])}


def chain(n, ids):
    return [(ids[i], ids[i + 1]) for i in range(n - 1)]


SHAPES = {
    "chain up": chain(1000, list(range(1000))),
    "chain down": [(b, a) for a, b in chain(1000, list(range(999, -1, -1)))],
    "chain shuffled": chain(1000, random.Random(1).sample(range(5000), 1000)),
    "star": [(700, i) for i in range(1400)] + [(i, 700) for i in range(50)],
    "grid": [(30 * i + j, 30 * i + j + d) for i in range(30) for j in range(29) for d in (1, 30)],
    "loops and repeats": [(5, 5), (7, 9), (9, 7), (7, 9), (-3, 9), (11, 12)],
    "random": [(random.Random(i).randrange(900), random.Random(-i).randrange(900)) for i in range(700)],
}


@pytest.mark.parametrize("shape", list(SHAPES))
def test_shapes(spark, shape):
    pairs = SHAPES[shape]
    assert dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect())) == least_reached(pairs)


def test_null_ends_and_empty(spark):
    got = components(spark.createDataFrame([(1, None), (None, 2), (4, 3)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(3, 3), (4, 3)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimates_end_at_checkpoints(spark):
    t = spark.range(5).select(F.col("id").alias("k"), F.col("id").alias("v"))
    for _ in range(20):
        t = checkpointed(t.join(t.select("k", F.col("v").alias("w")), "k").select("k", F.col("w").alias("v")))
    assert estimated_bits(t) < 128
    assert sorted(map(tuple, t.collect())) == [(i, i) for i in range(5)]
