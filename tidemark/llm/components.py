"""Connected components of a links table, by contraction; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed, forget_shuffles


def components(links: DataFrame) -> DataFrame:
    """links (a, b) bigint -> (node, comp), comp being the smallest node that links reach. Repeated links, loops and either direction are fine; links with a null end say nothing; an empty table gives an empty one.

    In each round nodes are ranked by a hash that is drawn anew. Every node moves to the first in rank among itself and its neighbours, and on to where that one
    moves; links then join the places moved to. A node stays only if it is before all its neighbours, or if one that does moves to it, so whatever the ids and the
    shape, a fixed share of the nodes with links is expected to go in each round, and rounds grow with the logarithm of their number. The least id of a component is found at the end.
    """
    edges = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels, rounds = None, 0
    while True:
        drawn = lambda c: F.struct(F.xxhash64(F.lit(rounds), c).alias("h"), F.col(c).alias("node"))
        first = edges.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("least")).select("node", F.least(drawn("node"), "least")["node"].alias("to"))
        first = checkpointed(first)
        moves = checkpointed(first.join(first.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        moved = moves.select(F.col("node").alias("comp"), "to")
        labels = moves.select("node", F.col("to").alias("comp")) if labels is None else checkpointed(labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        ends = lambda c: moves.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        edges = checkpointed(edges.join(ends("a"), "a").join(ends("b"), "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
        rounds += 1
        if edges.isEmpty():
            break
        # A round's tables are small but have as many files as partitions; those that nothing refers to any more go now.
        del first, moves, moved
        forget_shuffles(links.sparkSession)
    # A place is itself a node of its component, so the least member is the component's smallest node.
    least = labels.groupBy("comp").agg(F.min("node").alias("least"))
    return checkpointed(labels.join(least, "comp").select("node", F.col("least").alias("comp")))
