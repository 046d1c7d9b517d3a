"""Tag sets as sorted arrays of strings, and the wildcard tag that symbolic tokens carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "*"


def normalized(kinds: Column) -> Column:
    """Distinct and sorted; null counts as empty."""
    return F.array_sort(F.array_distinct(F.coalesce(kinds, F.array().cast("array<string>"))))


def intersected(kinds: Column, target: Column) -> Column:
    """What of kinds the target accepts: an empty target accepts all; without a concrete hit the wildcard takes on the target's kinds."""
    hits = F.array_intersect(kinds, target)
    adopted = F.when(F.array_contains(kinds, WILDCARD), normalized(target)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(target) == 0, kinds).when(F.size(hits) > 0, hits).otherwise(adopted)


def vocabulary(*occurrences, column: str = "kinds"):
    """Sorted distinct tags of some tables with a kinds column, one row each."""
    tags = [x.select(F.explode(column).alias("kind")) for x in occurrences]
    every = tags[0]
    for t in tags[1:]:
        every = every.unionByName(t)
    return every.distinct()


def expanded(sanitizers, *others):
    """Sanitizers whose empty kinds list stands for the whole vocabulary of the other tables."""
    tags = vocabulary(*others).agg(F.array_sort(F.collect_set("kind")).alias("all_kinds"))
    return sanitizers.crossJoin(F.broadcast(tags)).withColumn("kinds", F.when(F.size("kinds") == 0, F.col("all_kinds")).otherwise(F.col("kinds"))).drop("all_kinds")
