"""Rules by the segments of their patterns, as a trie in a table that expressions walk by equi-joins.

A node of the trie is the path that leads to it: a root, then the segments of a pattern. Roots are the ends from which patterns are read: `f` for those that begin a chain, `b` for those
that end one (read backwards), `i` for identifiers, `c` for called names; `f` and `b` have a `1` where dynamic segments may stand for any. A rule is a leaf under the first of
its conditions, the others are looked at when it is reached. From a node an edge leads on for a segment of its own, for any segment (a pattern's `*`) and, if rules allow it, for a dynamic one, so that each
step is one join on (node, key) and no rule is held against an expression that doesn't share a path with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans.model import checkpointed

ANY = "*"
#: Bytes of a catalogue's tables that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
_ANY, _DYNAMIC, _END = "a", "d", "e"


def segments_of(chain: Column) -> Column:
    return F.filter(F.split(chain, r"\."), lambda s: s != "")


def _literal(segment: Column) -> Column:
    return F.concat(F.lit("s"), segment)


def anchored(rules: DataFrame) -> DataFrame:
    """rules with root and parts, the path under it; rules without a condition, or with a member without segments, match nothing and go."""
    parts = segments_of(F.col("member"))
    backward = F.col("member").startswith(".")
    loose = F.when(F.coalesce(F.col("allow_dynamic"), F.lit(False)), "1").otherwise("0")
    root = F.when(F.col("member").isNotNull(), F.concat(F.when(backward, "b").otherwise("f"), loose)).when(F.col("identifier").isNotNull(), "i").when(F.col("call").isNotNull(), "c")
    path = F.when(F.col("member").isNotNull(), F.when(backward, F.reverse(parts)).otherwise(parts)).otherwise(F.array(F.coalesce("identifier", "call")))
    return rules.withColumn("_root", root).withColumn("_parts", path).where("_root is not null and size(_parts) > 0")


def _node(root: Column, parts: Column) -> Column:
    """A path as one string; segments have no dots, and identifiers and names are paths of one."""
    return F.array_join(F.concat(F.array(root), parts), ".")


def trie(anchors: DataFrame) -> DataFrame:
    """anchored rules -> parent, key, child, over: the edges, and for each leaf one that ends there (over)."""
    steps = anchors.select("_root", "_parts", F.explode(F.sequence(F.lit(1), F.size("_parts"))).alias("k"))
    part = F.element_at("_parts", F.col("k"))
    chain = F.substring("_root", 1, 1).isin("f", "b")
    keys = F.when(chain & (part == ANY), F.array(F.lit(_ANY))).when(F.col("_root").endswith("1"), F.array(_literal(part), F.lit(_DYNAMIC))).otherwise(F.array(_literal(part)))
    prefix = lambda n: _node(F.col("_root"), F.slice("_parts", F.lit(1), n))
    edges = steps.select(prefix(F.col("k") - 1).alias("parent"), F.explode(keys).alias("key"), prefix(F.col("k")).alias("child"), F.lit(False).alias("over"))
    leaf = _node(F.col("_root"), F.col("_parts"))
    return edges.unionByName(anchors.select(leaf.alias("parent"), F.lit(_END).alias("key"), leaf.alias("child"), F.lit(True).alias("over"))).distinct()


def _sized(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its bytes are within the bound. They are counted, as an estimate wouldn't do."""
    n = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def walked(expressions: DataFrame, edges: DataFrame, depth: int, roots: list[str]) -> DataFrame:
    """expressions (node_id, segments, identifier, last, is_call) -> node_id, identifier, name (what is called) and each leaf that they reach, from the roots that the trie has."""
    name = F.when(F.coalesce("is_call", F.lit(False)), F.coalesce("last", "identifier"))
    start = lambda root, path: F.when(path.isNotNull(), F.struct(F.lit(root).alias("at"), path.alias("path"), F.lit(root[0] in "fb").alias("chain")))
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    begin = {"f": F.col("segments"), "b": F.reverse("segments"), "i": one(F.col("identifier")), "c": one(name)}
    starts = F.array_compact(F.array(*[start(r, begin[r[0]]) for r in roots]))
    rows = expressions.select("node_id", "identifier", name.alias("name"), F.explode(starts).alias("s")).select("node_id", "identifier", "name", "s.*").withColumn("over", F.lit(False))
    for k in range(depth + 1):
        segment = F.get("path", F.lit(k))
        dynamic = F.col("chain") & (segment == ANY)
        onward = F.when(segment.isNull(), F.array().cast("array<string>")).when(dynamic, F.array(F.lit(_DYNAMIC), F.lit(_ANY))).when(F.col("chain"), F.array(_literal(segment), F.lit(_ANY))).otherwise(F.array(_literal(segment)))
        ending = F.array(F.lit(_END))
        # What has ended stays where it is; what goes on may end here, too.
        keys = F.when(F.col("over"), ending).otherwise(F.concat(onward, ending)) if k else onward
        rows = rows.select("node_id", "identifier", "name", "at", "path", "chain", F.explode(keys).alias("key"))
        rows = rows.join(edges.select(F.col("parent").alias("at"), "key", "child", "over"), ["at", "key"]).select("node_id", "identifier", "name", F.col("child").alias("at"), "path", "chain", "over")
    return rows.where("over").select("node_id", "identifier", "name", F.col("at").alias("leaf"))


def rule_hits(expressions: DataFrame, rules: DataFrame) -> DataFrame:
    """All pairs of an expression and a rule that it fulfils: node_id and the rule's columns."""
    anchors = checkpointed(anchored(rules).coalesce(1))
    edges = checkpointed(trie(anchors))
    depth, roots = anchors.agg(F.max(F.size("_parts")), F.array_sort(F.collect_set("_root"))).first()
    if depth is None:
        spark = expressions.sparkSession
        return spark.createDataFrame([], StructType([expressions.schema["node_id"], *rules.schema.fields]))
    own = [F.col(c).alias(f"_r_{c}") for c in rules.columns]
    leaves = anchors.select(_node(F.col("_root"), F.col("_parts")).alias("leaf"), *own)
    met = walked(expressions, _sized(edges), depth, roots).join(_sized(leaves), "leaf")
    fits = lambda rule, value: F.col(rule).isNull() | F.coalesce(F.col(rule) == F.col(value), F.lit(False))
    return met.where(fits("_r_identifier", "identifier") & fits("_r_call", "name")).select("node_id", *[F.col(f"_r_{c}").alias(c) for c in rules.columns])
