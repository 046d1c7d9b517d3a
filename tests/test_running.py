"""The scan in two levels against one window."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.running import running


@pytest.mark.parametrize("inclusive", [True, False])
def test_same_as_a_window(spark, inclusive):
    r = random.Random(4)
    keys = [None, "hot", "hot", "hot", "a", "b"]
    rows = [(r.choice(keys), k, r.choice([None, r.randint(0, 1000)]), r.randint(0, 9)) for k in r.sample(range(4000), 3000)] + [("lone", 1, None, 1)]
    df = spark.createDataFrame(rows, "k string, at int, v int, n int").repartition(5)
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    pair = F.struct("v", "n")
    want = df.withColumn("top", F.max("v").over(w)).withColumn("low", F.min("v").over(w)).withColumn("all", F.sum("n").over(w)).withColumn("best", F.max(F.when(F.col("v").isNotNull(), pair)).over(w))
    got = running(df, ["k"], ["at"], {"top": (F.max, F.col("v")), "low": (F.min, F.col("v")), "all": (F.sum, F.col("n")), "best": (F.max, F.when(F.col("v").isNotNull(), pair))}, inclusive)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_one_key_is_many_tasks(spark):
    """A million rows of one key: no task takes more than a few of the ranges' shares."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(1_000_000).select(F.lit("k").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("at"), F.lit(1).alias("n"))
        out = running(df, ["k"], ["at"], {"place": (F.sum, F.col("n"))}).withColumn("task", F.spark_partition_id())
        sizes = [x["count"] for x in out.groupBy("task").count().collect()]
        assert len(sizes) >= 8 and max(sizes) < 300_000
        assert out.agg(F.count_distinct("place"), F.max("place")).first()[:] == (1_000_000, 1_000_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_empty(spark):
    assert running(spark.createDataFrame([], "k string, at int, n int"), ["k"], ["at"], {"s": (F.sum, F.col("n"))}).count() == 0
