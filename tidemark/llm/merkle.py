"""A Merkle manifest of a dataset: leaves, one tree a source, one tree over the sources, and for each row a proof.

Leaves take their place by a range sort and prefix sums over its partitions. Parents are then made by an event-driven combineByKey. The arrival of a digest is an event: it
goes to the partial parent of its run, which accumulates digests by index; the parent knows from its tree's size how many children it will have
(16, fewer in the last run), and on the last one it becomes a digest itself, which arrives at its own parent, and so on up to the subroot, which arrives in the tree over
sources. As leaves come sorted, a task finishes all parents that lie within its rows at once; the few that reach past its ends, about one a level, are left as partial parents. These unresolved frontiers are
reshuffled by key, their boxes merged by combineByKey, and what is complete emits its ancestors, until none is left: a round for each level at most, over few rows.

Every finished parent is written with its children, which are reverse links: from the root down, each run hands its children the way above them together with their siblings.
A leaf's way is thus joined once a run, not built once a leaf.

Rows are placed by source (null first, bytewise), doc_id (null first), then leaf digest; rows that agree in these are alike and take neighbouring places in any order, with the
proofs of those places. Null values count as `-`; an empty text is `0:`. A long text is hashed where it is read and never moved. A null doc_id is never tampered with. An empty table gives an
empty result. Columns beyond the five that are hashed are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed

#: Children of a parent.
ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over sources; the others are numbered from 0 in the order of their sources.
TOP = -1
#: Partitions and sources (some 50 bytes each) whose offsets may be broadcast; more are joined by a shuffle.
BROADCAST_PLACES = 100_000
_NODE = "tree long, n long, level int, place long, slots array<int>, children array<string>, digest string"
_ARROW = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("slots", pa.list_(pa.int32())), ("children", pa.list_(pa.string())), ("digest", pa.string())])
_STEP = "array<struct<left:string,right:string>>"


def leaf_digest(text: Column) -> Column:
    """sha256 of the five fields, each `-` if null, else its UTF-8 byte count, `:` and value."""
    value = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[value(text if c == "text" else F.col(c).cast("string")) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and tampered: the leaf of a text with A-Z in lower case, null where nothing was tampered with."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("doc_id", "source", leaf_digest(F.col("text")).alias("leaf"), F.when(chosen, leaf_digest(lower)).alias("tampered"))


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (doc_id, source, leaf, ...) with tree (the source's number), n (its rows) and pos (0, 1, ... in the tree), in order within partitions; and the number of trees."""
    rows = checkpointed(rows.withColumn("_key", F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))).withColumn("_row", F.monotonically_increasing_id()))
    order = ["_key", "doc_id", "leaf", "_row"]
    rows = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()).drop("_row"))
    # A source has one row here for each partition that it reaches into.
    parts = checkpointed(rows.groupBy("_key", "_part").agg(F.min("_seq").alias("low"), F.count("*").alias("here")))
    own, before = Window.partitionBy("_key"), Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("low")).withColumn("n", F.sum("here").over(own)).withColumn("first", F.min("low").over(own))
    # Sources are numbered by where they begin: within a partition, after those of the partitions before. The totals are one row a partition.
    begun = offsets.where("low = first").select("_key", "_part", "low")
    totals = begun.groupBy("_part").agg(F.count("*").alias("many"))
    totals = totals.select("_part", F.coalesce(F.sum("many").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbers = begun.join(totals, "_part").select("_key", (F.col("earlier") + F.row_number().over(Window.partitionBy("_part").orderBy("low")) - 1).alias("tree"))
    places = checkpointed(offsets.join(numbers, "_key").select("_key", "_part", "offset", "n", "tree"))
    few = places.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    out = rows.join(F.broadcast(places) if few else places, ["_key", "_part"]).sortWithinPartitions("_seq").withColumn("pos", F.col("_seq") + F.col("offset"))
    return checkpointed(out.drop("_key", "_part", "_seq", "offset")), numbers.count()


def joined_digest(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Boxes:
    """Partial parents of a task: digests arrive, complete parents are written down and arrive in turn."""

    def __init__(self, n_trees: int):
        self.n_trees, self.open, self.rows = n_trees, {}, []

    def arrive(self, tree: int, n: int, level: int, place: int, digest: str) -> None:
        """place: the digest's place among the nodes of its level."""
        while True:
            size = -(-n // ARITY**level)
            if size == 1:
                if tree == TOP:
                    self.rows.append((TOP, n, level, 0, [], [], digest))
                    return
                tree, n, level, place = TOP, self.n_trees, 0, tree
                continue
            digest = self.put((tree, n, level + 1, place // ARITY), {place % ARITY: digest})
            if digest is None:
                return
            level, place = level + 1, place // ARITY

    def put(self, parent: tuple[int, int, int, int], box: dict[int, str]) -> str | None:
        """Digests by slot join those that wait at their parent; its digest if it has all now."""
        tree, n, level, place = parent
        held = self.open.setdefault(parent, {})
        held.update(box)
        if len(held) < min(ARITY, -(-n // ARITY ** (level - 1)) - ARITY * place):
            return None
        del self.open[parent]
        slots = sorted(held)
        children = [held[k] for k in slots]
        digest = joined_digest(children)
        self.rows.append((tree, n, level, place, slots, children, digest))
        return digest

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def unresolved(self) -> Iterator[tuple]:
        for (tree, n, level, place), held in self.open.items():
            yield (tree, n, level, place, list(held), list(held.values()), None)


def nodes(leaves: DataFrame, n_trees: int) -> tuple[DataFrame, str]:
    """leaves (tree, n, pos, leaf), sorted within partitions -> all parents (tree, n, level from 1, place, children, digest), and the root."""
    spark = leaves.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = Boxes(n_trees)
        for batch in batches:
            for tree, n, pos, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                boxes.arrive(tree, n, 0, pos, leaf)
            if boxes.rows:
                yield boxes.taken()
        boxes.rows += boxes.unresolved()
        if boxes.rows:
            yield boxes.taken()

    def met(parents) -> Iterator[tuple]:
        boxes = Boxes(n_trees)
        for parent, box in parents:
            digest = boxes.put(parent, box)
            if digest is not None:
                tree, n, level, place = parent
                boxes.arrive(tree, n, level, place, digest)
            yield from boxes.rows
            boxes.rows = []
        yield from boxes.unresolved()

    done, last = [], checkpointed(leaves.select("tree", "n", "pos", "leaf").mapInArrow(first, _NODE))
    while True:
        done.append(last.where("digest is not null").drop("slots"))
        left = last.where("digest is null")
        if left.isEmpty():
            break
        events = left.rdd.map(lambda r: ((r["tree"], r["n"], r["level"], r["place"]), dict(zip(r["slots"], r["children"], strict=True))))
        together = events.combineByKey(lambda box: box, lambda a, b: a | b, lambda a, b: a | b)
        last = checkpointed(spark.createDataFrame(together.mapPartitions(met), _NODE))
    every = checkpointed(reduce(DataFrame.unionByName, done))
    root = every.where((F.col("tree") == TOP) & (F.size("children") == 0)).first()
    return every.where(F.size("children") > 0), root["digest"] if root else ""


def _step(slot: Column) -> Column:
    """What stands left and right of a run's child."""
    side = lambda begin, n: F.array_join(F.slice("children", begin, n), "")
    return F.array(F.struct(side(F.lit(1), slot).alias("left"), side(slot + 2, F.lit(ARITY)).alias("right")))


@dataclass
class Manifest:
    """leaves: those given, with tree, n, pos. parents: tree (-1 over sources), level, place, children, digest."""

    leaves: DataFrame
    parents: DataFrame
    n_trees: int
    root: str


def manifest(rows: DataFrame) -> Manifest:
    own, n_trees = placed(rows)
    parents, root = nodes(own, n_trees)
    return Manifest(own, parents, n_trees, root)


def proofs(m: Manifest) -> DataFrame:
    """m.leaves with subroot and way: for each level from the leaf to the root the digests left and right of the node, joined."""
    runs = lambda level, top: m.parents.where((F.col("level") == level) & ((F.col("tree") == TOP) if top else (F.col("tree") != TOP)))
    spread = lambda df, *more: df.select(*more, "place", "children", "way", F.posexplode("children").alias("slot", "child"))
    below = lambda: (F.col("place") * ARITY + F.col("slot")).alias("place")
    on = lambda: F.concat(_step(F.col("slot")), "way").alias("way")
    height = 0
    while ARITY**height < m.n_trees:
        height += 1
    spark = m.leaves.sparkSession
    ways = spark.createDataFrame([(0, m.root, [])], f"place long, child string, way {_STEP}")
    for level in range(height, 0, -1):
        ways = spread(runs(level, True).join(ways.select("place", "way"), "place")).select(below(), "child", on())
    tops = checkpointed(ways.select(F.col("place").alias("tree"), F.col("child").alias("subroot"), "way"))
    tallest = m.parents.where(F.col("tree") != TOP).agg(F.max("level")).first()[0] or 0
    ways = None
    for level in range(tallest, 0, -1):
        # Parents on top of their tree begin with what the tree over sources gave it, the others with what the run above gave them.
        tip = runs(level, False).where(F.col("n") <= ARITY**level).join(tops, "tree")
        if ways is not None:
            tip = tip.unionByName(runs(level, False).where(F.col("n") > ARITY**level).join(ways, ["tree", "place"]))
        ways = checkpointed(spread(tip, "tree", "subroot").select("tree", "subroot", below(), on())) if level > 1 else tip.select("tree", "subroot", "place", "children", "way")
    lone = m.leaves.where("n = 1").join(tops, "tree")
    if ways is None:
        return lone
    low = m.leaves.where("n > 1").withColumn("place", F.expr(f"pos div {ARITY}")).join(ways, ["tree", "place"])
    low = low.withColumn("way", F.concat(_step((F.col("pos") % ARITY).cast("int")), "way")).drop("place", "children")
    return low.unionByName(lone)


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(way, leaf, lambda made, s: F.sha2(F.concat(s["left"], made, s["right"]), 256))


def proof_digest(way: Column) -> Column:
    return F.sha2(F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def merkle_digest(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; a proof folds the tampered leaf where there is one."""
    m = manifest(leaves(docs))
    out = proofs(m).select("doc_id", "leaf", "subroot", F.lit(m.root).alias("root"), proof_digest(F.col("way")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("way")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(text: str) -> str:
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END"
    return "sha256(" + " || ".join(value(text if c == "text" else f"CAST({c} AS VARCHAR)") for c in FIELDS) + ")"


#: crc32 of an id, bit by bit: DuckDB has no function for it.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, _: CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""

ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
  CASE WHEN xor({_CRC}, 4294967295) % 5 = 0 THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_sql_leaf('text')} END AS used FROM documents),
t AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM d)),
p AS (SELECT doc_id, leaf, used, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
low(tree, level, idx, digest) AS (SELECT tree, 0, pos, leaf FROM p UNION ALL
  SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, level, idx // 16),
sub AS (SELECT tree, max(level) AS height, arg_max(digest, level) AS digest FROM low GROUP BY tree),
high(level, idx, digest) AS (SELECT 0, tree, digest FROM sub UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, idx // 16),
root AS (SELECT max(level) AS height, arg_max(digest, level) AS digest FROM high),
own AS (SELECT tree, pos, k AS step, tree AS at, k AS level, CAST(floor(pos / power(16, k)) AS BIGINT) AS idx FROM p JOIN sub USING (tree), unnest(range(height)) AS u(k)
  UNION ALL SELECT tree, pos, sub.height + k, -1, k, CAST(floor(tree / power(16, k)) AS BIGINT) FROM p JOIN sub USING (tree), root, unnest(range(root.height)) AS u(k)),
every AS (SELECT tree AS at, level, idx, digest FROM low UNION ALL SELECT -1, level, idx, digest FROM high),
steps AS (SELECT o.tree, o.pos, o.step, coalesce(string_agg(e.digest, '' ORDER BY e.idx) FILTER (e.idx < o.idx), '') AS l, coalesce(string_agg(e.digest, '' ORDER BY e.idx) FILTER (e.idx > o.idx), '') AS r
  FROM own o JOIN every e ON e.at = o.at AND e.level = o.level AND e.idx // 16 = o.idx // 16 GROUP BY ALL),
fold(tree, pos, step, made) AS (SELECT tree, pos, 0, used FROM p UNION ALL SELECT f.tree, f.pos, f.step + 1, sha256(s.l || f.made || s.r) FROM fold f JOIN steps s USING (tree, pos, step)),
ends AS (SELECT tree, pos, arg_max(made, step) AS folded_root FROM fold GROUP BY tree, pos),
shown AS (SELECT tree, pos, sha256(coalesce(string_agg(l || r, '' ORDER BY step), '')) AS proof_sha256 FROM p LEFT JOIN steps USING (tree, pos) GROUP BY tree, pos)
SELECT doc_id, leaf, sub.digest AS subroot, root.digest AS root, proof_sha256, folded_root, folded_root = root.digest AS verified
FROM p JOIN sub USING (tree) JOIN ends USING (tree, pos) JOIN shown USING (tree, pos), root"""
