"""Running values within keys of any size: a scan in two levels, so that one key is many tasks' work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.model import checkpointed


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[Callable[[Column | str], Column], Column]], inclusive: bool = True) -> DataFrame:
    """rows with a column for each of values: its aggregate (max, min, sum) of what comes up to the row in its key, by order, or before it if not inclusive.

    Rows are dealt into ranges of (keys, order), so that a large key is in many. Each range runs by itself, ranges hand on their totals, which are one row for each key in a range, and
    what came in before is added. Rows alike in keys and order come one after another, in any order.
    """
    names = list(values)
    with_values = rows.withColumns({f"_v_{n}": v for n, (_, v) in values.items()}).withColumn("_tie", F.monotonically_increasing_id())
    dealt = checkpointed(with_values.repartitionByRange(*keys, *order, "_tie").withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", *keys).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    here = dealt.withColumns({f"_h_{n}": values[n][0](f"_v_{n}").over(own) for n in names})
    totals = dealt.groupBy(*keys, "_range").agg(*[values[n][0](f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumns({f"_c_{n}": values[n][0](f"_t_{n}").over(before) for n in names}).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_at"), *[f"_c_{n}" for n in names])
    # Only keys that reach into several ranges have something to carry; few others than those are joined.
    carried = checkpointed(carried.where(" or ".join(f"_c_{n} is not null" for n in names)))
    on = [here["_range"] == carried["_at"], *[here[k].eqNullSafe(carried[f"_k_{k}"]) for k in keys]]
    met = here.join(carried, on, "left")
    both = lambda n: values[n][0]
    joined = {F.max: F.greatest, F.min: F.least}
    out = {n: joined[both(n)](F.col(f"_c_{n}"), F.col(f"_h_{n}")) if both(n) in joined else F.when(F.col(f"_c_{n}").isNull(), F.col(f"_h_{n}")).otherwise(F.col(f"_c_{n}") + F.coalesce(f"_h_{n}", F.lit(0))) for n in names}
    return met.withColumns(out).select(*rows.columns, *names)
