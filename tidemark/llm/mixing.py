"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Sources, by code point with null last, weigh 3, 1, 2, repeating, and share 150% of all words. Targets stop at twice their
   source's size and the excess is reshared by weight: in order of cap over weight, a running sum tells which are capped.
2. A seeded hash permutes each source's documents; ranges of it are the source's blocks, so the number of blocks is bounded (MOST_BLOCKS) and no
   window ever holds a source's documents. A source's quota is as many whole passes as fit its target, then blocks in order; in the
   block at the edge documents are taken in hash order as long as they fit.
3. Block quotas of all sources are partitioned among output shards by a binary tree: a node sends half of its draws left, source
   by source, each number drawn from the exact hypergeometric distribution given what is left (inverse of the distribution
   function at a seeded hash). Shards thus hold disjoint ranges of every source's draws.
4. Within a shard, rows are ordered by a seeded hash of shard, pass and document.

Reruns give equal results. A null text has no words; such documents are taken 0 times their size. Sources whose documents have
no words have target 0. Rows that repeat a doc_id are placed one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import WORD_SQL, checkpointed

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 32_768
MOST_BLOCKS = 65_536
#: Output shards, a power of two.
SHARDS = 8
#: Rows of a table by source that may be broadcast; beyond them it is joined by a shuffle over salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 32


def attach(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows with the columns of by_source (one row a source, null included)."""
    right = by_source.withColumnRenamed("source", "_source")
    if right.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(right), rows["source"].eqNullSafe(right["_source"])).drop("_source")
    rows = rows.withColumn("_salt", F.pmod("key", F.lit(SALTS)))
    right = right.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(right, rows["source"].eqNullSafe(right["_source"]) & (rows["_salt"] == right["_other"])).drop("_source", "_salt", "_other")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also place (from 0), weight, target. One row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("place") % len(WEIGHTS) + 1)
    given = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(CAP))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    on = by_cap.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * SHARE
    fair = given.withColumn("total", total).withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on))
    capped = fair.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    return capped.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * left / open_weight)).select("source", "source_size", "place", "weight", "target")


def hypergeometric_sql(total: str, marked: str, drawn: str, uniform: str) -> str:
    """A draw's number of marked ones, as SQL: the least k at which the distribution function reaches uniform. Weights start at 1 twelve standard
    deviations below the mean and follow from their quotients, so no logarithm or factorial is needed; beyond, chances are below 1e-30."""
    share = f"({marked} / greatest({total}, 1))"
    mean = f"({drawn} * {share})"
    deviation = f"sqrt(greatest(0, {mean} * (1 - {share}) * ({total} - {drawn}) / greatest({total} - 1, 1)))"
    low = f"greatest(greatest(0L, {drawn} - ({total} - {marked})), cast(floor({mean} - 12 * {deviation}) as bigint) - 1)"
    high = f"least(least({drawn}, {marked}), cast(ceil({mean} + 12 * {deviation}) as bigint) + 1)"
    ratio = f"(cast({marked} - k as double) * ({drawn} - k)) / (cast(k + 1 as double) * greatest({total} - {marked} - {drawn} + k + 1, 1))"
    steps = f"sequence({low}, greatest({low}, {high}))"
    whole = f"aggregate({steps}, named_struct('w', 1D, 't', 0D), (s, k) -> named_struct('w', s.w * {ratio}, 't', s.t + s.w), s -> s.t)"
    return (
        f"aggregate({steps}, named_struct('w', 1D, 't', 0D, 'at', cast(null as bigint)), (s, k) -> named_struct('w', s.w * {ratio}, 't', s.t + s.w, "
        f"'at', coalesce(s.at, if(s.t + s.w >= {uniform} * {whole}, k, null))), s -> coalesce(s.at, {high}))"
    )


def split(nodes: DataFrame, seed: int) -> DataFrame:
    """nodes (node, quotas: array of place, n) -> its two children each, the left one with half of the draws."""
    uniform = f"(cast(pmod(xxhash64({seed}, node, x.place), 9007199254740992L) as double) / 9007199254740992D)"
    left = hypergeometric_sql("acc.rest", "x.n", "acc.draw", uniform)
    total = "aggregate(quotas, 0L, (t, x) -> t + x.n)"
    # The draw is made inside a one-element transform, so that it is made once.
    fold = (
        f"aggregate(quotas, named_struct('rest', {total}, 'draw', {total} div 2, 'made', cast(array() as array<bigint>)), "
        f"(acc, x) -> element_at(transform(array({left}), m -> named_struct('rest', acc.rest - x.n, 'draw', acc.draw - m, 'made', concat(acc.made, array(m)))), 1), acc -> acc.made)"
    )
    made = nodes.withColumn("made", F.expr(fold))
    child = lambda side, n: F.struct((F.col("node") * 2 + side).alias("node"), F.expr(f"zip_with(quotas, made, (x, m) -> named_struct('place', x.place, 'n', {n}))").alias("quotas"))
    return made.select(F.explode(F.array(child(0, "m"), child(1, "x.n - m"))).alias("c")).select("c.*")


def shard_offsets(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas (place, n) -> place, offsets: where each shard's range of the source's draws begins."""
    # Sources are counted, not documents: one row holds a number for each.
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("quotas")).select(F.lit(1).cast("bigint").alias("node"), "quotas")
    for _ in range(shards.bit_length() - 1):
        nodes = checkpointed(split(nodes, seed))
    leaves = nodes.select((F.col("node") - shards).alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.place", "q.n")
    per_source = leaves.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("a"))
    offsets = F.expr("aggregate(a, named_struct('t', 0L, 'o', cast(array() as array<bigint>)), (s, x) -> named_struct('t', s.t + x.n, 'o', concat(s.o, array(s.t))), s -> s.o)")
    return per_source.select("place", offsets.alias("offsets"))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, and placements: array of pass, shard and local order, one for each time the document is taken."""
    key = F.xxhash64(F.lit(seed), "doc_id", "source")
    rows = checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)), F.lit(0)).cast("bigint").alias("size"), key.alias("key")))
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    blocks = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    by_source = checkpointed(by_source.withColumn("blocks", blocks).withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    # 31 bits of the hash, spread over the source's blocks.
    block = F.shiftright(F.shiftrightunsigned("key", 33) * F.col("blocks"), 31)
    placed = attach(rows, by_source).withColumn("block", block)
    sums = placed.groupBy("place", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = Window.partitionBy("place").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).where(F.col("before") < F.col("rest")).groupBy("place").agg(F.max(F.struct("block", "before")).alias("e"))
    quota = by_source.join(edge, "place", "left").withColumn("edge", F.coalesce("e.block", F.lit(-1)).cast("bigint")).withColumn("edge_words", F.col("rest") - F.coalesce("e.before", F.lit(0))).drop("e")
    quota = checkpointed(quota.withColumn("n", F.col("passes") * F.col("blocks") + F.col("edge") + 1))
    plan = checkpointed(quota.join(shard_offsets(quota.select("place", "n"), shards, seed), "place"))
    drawn = attach(rows, plan).withColumn("block", block)
    # One block a source is cut: in hash order, each document that still fits is taken.
    cut = drawn.where("block = edge and size > 0").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("key", "doc_id", "size", "source"))).alias("d"), F.first("edge_words").alias("edge_words"))
    fits = "aggregate(d, named_struct('t', 0L, 'm', cast(array() as array<boolean>)), (s, x) -> named_struct('t', s.t + if(s.t + x.size <= edge_words, x.size, 0L), 'm', concat(s.m, array(s.t + x.size <= edge_words))), s -> s.m)"
    inside = cut.select(F.explode(F.arrays_zip("d", F.expr(fits).alias("more"))).alias("z")).select("z.d.doc_id", "z.d.source", "z.d.size", "z.d.key", "z.more")
    whole = drawn.where("block <> edge or size = 0").withColumn("more", F.col("block") < F.col("edge"))
    both = whole.unionByName(attach(inside, plan).withColumn("block", block))
    times = F.col("passes") + F.col("more").cast("bigint")
    taken = F.when(F.col("size") > 0, times).otherwise(0)
    passes_taken = F.when(taken > 0, F.sequence(F.lit(0).cast("bigint"), taken - 1)).otherwise(F.array().cast("array<bigint>"))

    def placement(p):
        shard = F.size(F.filter("offsets", lambda o: o <= p * F.col("blocks") + F.col("block"))) - 1
        return F.struct(p.alias("pass"), shard.alias("shard"), F.xxhash64(F.lit(seed + 1), p, F.col("doc_id")).alias("order"))

    placements = F.transform(passes_taken, placement)
    made = both.select("doc_id", "source", "size", "source_size", "target", placements.alias("placements"))
    return made.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("placements")).cast("bigint").alias("taken"), "placements")


def write_mix(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 3) -> None:
    """docs as often as the mix takes them, one folder a shard, rows in the shard's local order."""
    places = mix(docs, shards, seed).select("doc_id", "source", F.explode("placements").alias("at")).select("doc_id", F.col("source").alias("_source"), "at.*")
    rows = docs.join(places, "doc_id").where(docs["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rows.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").write.partitionBy("shard").parquet(path)


def mix_digest(docs: DataFrame) -> DataFrame:
    """The mix with the shard of each time that a document is taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.transform("placements", lambda p: p["shard"]).alias("shards"))
