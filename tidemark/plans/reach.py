"""Which states there are, and at which level each is first met, without who came first: no parents, budgets or depths of calls.

What a state may do depends on its node, kinds and argument position, never on its source. Sources are therefore numbered and travel together: a row is a node, its kinds, an argument position and a word of 64 sources, one bit each.
A move carries a word in one row, arrivals combine by OR before they are sent, and a level keeps the bits that are new. With few sources a row stands for all of them; with many, for those of a word that meet at a node.
Names are put back where rows leave, by `named`, or `apart` for one row a state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tags import normalized
from tidemark.plans.fixpoint import JOINED, NO_ARG, bind_params, dealt, moves, towards
from tidemark.plans.model import Graph, Occurrences, SolveOptions, checkpointed, let_go, small
from tidemark.plans.store import Store

#: What a set of sources belongs to; its bits say which sources of the word are there.
SET = ("node", "kinds_key", "arg", "word")
#: Names that one task numbers.
NAMES = 100_000


@dataclass
class Reached:
    """sets: node, kinds, arg, word, bits, level, each bit in the level that first has it. names: word, ids (a word's sources by bit)."""

    sets: DataFrame
    names: DataFrame

    def named(self, rows: DataFrame) -> DataFrame:
        """rows (word, bits, ...) with source_ids, an array, in place of both."""
        return rows.join(small(self.names), "word").withColumn("source_ids", F.filter("ids", lambda x, i: F.getbit("bits", i) == 1)).drop("ids", "word", "bits")

    def apart(self, rows: DataFrame) -> DataFrame:
        """rows (word, bits, ...) with source_id in place of both, a row for each source."""
        named = self.named(rows)
        return named.select(*[c for c in named.columns if c != "source_ids"], F.explode("source_ids").alias("source_id"))


def _bits(c: str) -> Column:
    return F.bit_or(c).alias("bits")


def _numbered(sources: DataFrame) -> DataFrame:
    """source_id, word, bit: bits of a word in order of names, without gaps."""
    names = checkpointed(sources.select("source_id").distinct())
    tasks = names.count() // NAMES + 1
    ranged = names.repartitionByRange(tasks, "source_id").sortWithinPartitions("source_id").withColumn("n", F.monotonically_increasing_id())
    return checkpointed(ranged.select("source_id", F.shiftright("n", 6).alias("word"), (F.col("n") % 64).cast("int").alias("bit")))


def _clearing(sanitizers: DataFrame) -> DataFrame:
    """clear_node, wiped, cleared: what each node's valid sanitisers take together; one without kinds takes everything."""
    return sanitizers.where("valid").groupBy(F.col("node_id").alias("clear_node")).agg(F.bool_or(F.coalesce(F.size("kinds"), F.lit(0)) <= 0).alias("wiped"), normalized(F.flatten(F.collect_list("kinds"))).alias("cleared"))


def _sanitised(rows: DataFrame) -> DataFrame:
    left = F.when(F.col("cleared").isNull(), F.col("kinds_key")).otherwise(F.array_join(F.array_except(F.split("kinds_key", JOINED), "cleared"), JOINED))
    return rows.where(~F.coalesce("wiped", F.lit(False))).withColumn("kinds_key", left).where("kinds_key <> ''").drop("wiped", "cleared")


def reach(graph: Graph, occurrences: Occurrences) -> Reached:
    """A round sends its frontier to the moves' buckets and its arrivals, combined, to the buckets of the sets seen; neither moves nor sets seen are shuffled again."""
    spark = graph.nodes.sparkSession
    store, clears = Store(spark), checkpointed(_clearing(occurrences.sanitizers))
    options = SolveOptions(max_call_depth=0, ordered=False)
    ways = moves(graph, checkpointed(bind_params(graph)), options).join(clears.withColumnRenamed("clear_node", "dst"), "dst", "left")
    ways, way_key, hubs = dealt(store, ways.select("src", "dst", "next_arg", "needs_arg", "wiped", "cleared"))
    real = occurrences.sources.where(F.size("kinds") > 0)
    numbers = _numbered(real)
    seeds = real.select(F.col("node_id").alias("node"), "source_id", F.array_join(normalized(F.col("kinds")), JOINED).alias("kinds_key")).join(graph.nodes.select(F.col("id").alias("node")), "node")
    seeds = _sanitised(seeds.join(clears.withColumnRenamed("clear_node", "node"), "node", "left")).withColumnRenamed("source_id", "s").join(small(numbers), F.col("s").eqNullSafe(F.col("source_id")))
    first, rounds = seeds.withColumn("arg", F.lit(NO_ARG)).withColumn("one", F.expr("shiftleft(1L, bit)")).groupBy(*SET).agg(_bits("one")), 0
    while store.append("sets", first.withColumn("level", F.lit(rounds)), SET, "level"):
        let_go(spark)
        sets = store.table("sets")
        go = towards(sets.where(F.col("level") == rounds).select(F.col("node").alias("src"), "kinds_key", "arg", "word", "bits"), hubs)
        steps = go.join(ways, list(way_key)).where("needs_arg is null or needs_arg = arg").select(F.col("dst").alias("node"), "kinds_key", F.col("next_arg").alias("arg"), "word", "bits", "wiped", "cleared")
        arrived = _sanitised(steps).groupBy(*SET).agg(_bits("bits"))
        had = sets.groupBy(*SET).agg(F.bit_or("bits").alias("had"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        first = arrived.join(had, list(SET), "left").withColumn("bits", fresh).drop("had").where("bits <> 0")
        rounds += 1
    for name in ("ways", "spread"):
        store.drop(name)
    sets = store.released("sets").withColumn("kinds", F.split("kinds_key", JOINED)).drop("kinds_key")
    names = numbers.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("bit", "source_id"))), lambda s: s["source_id"]).alias("ids"))
    return Reached(sets, checkpointed(names))
