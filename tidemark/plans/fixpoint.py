"""Propagation of tag sets along a graph to a fixpoint.

A state is (node, source, sorted kinds, argument position). States arrive first-in-first-out, so the loop is level by
level: a round joins the frontier with the moves table, lets sanitisers clear kinds, keeps the first arrival of each new
key, and drops keys that were seen. Arrival order is the pair (arrival of the parent, rank of the move); it is kept as an
increasing number by range-partitioning each new level, so no level is ever sorted in one task. Paths are parent
pointers, followed for findings only.

What a round moves grows with its frontier alone: the moves lie in buckets by source node, with what their target's sanitisers clear, and the states seen in buckets by key, to which a round's new states are added. Neither is shuffled again;
the frontier goes to the moves' buckets, arrivals, combined before they are sent, to the buckets of the states. The moves of a node with more than HUB_MOVES lie in several buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.tags import WILDCARD, normalized
from tidemark.operators.running import running
from tidemark.plans.model import Graph, Occurrences, SolveOptions, checkpointed, empty, let_go, small
from tidemark.plans.store import Store

#: Argument position of a state that didn't arrive over an argument edge.
NO_ARG = -1_000_000
#: A state's key, kinds as one string, and what depends on its node.
KEY = ("node", "source_id", "kinds_key", "arg", "function_id", "node_kind")
#: Moves of one node that lie in one bucket.
HUB_MOVES = 1_000_000
#: Groups, by hash, in which functions' states are counted before they are counted by function.
GROUPS = 1 << 16
#: Stands between the kinds of a key.
JOINED = "\x01"
_USE = "array<struct<sanitizer_id:string,kinds:array<string>>>"


def bind_params(graph: Graph) -> DataFrame:
    """function_id, index, node_id: parameters meet the param node of their name, what is left meets the remaining nodes in id order.

    Parameters, the names they go by and param nodes are rows of one table, which is dealt out by function once; all that follows stays within a function.
    """
    none = F.lit(None)
    params = graph.functions.select(F.col("id").alias("function_id"), F.explode("params").alias("p"))
    nodes = graph.nodes.where("kind = 'param'").select("function_id", "label", none.cast("int").alias("index"), F.col("id").alias("node_id"))
    names = params.select("function_id", F.col("p.name").alias("label"), F.col("p.index").alias("index"), none.cast("string").alias("node_id"))
    parts = params.select("function_id", F.explode("p.destructured").alias("label"), F.col("p.index").alias("index"), F.lit("").alias("node_id"))
    rows = names.unionByName(nodes).unionByName(parts).where("function_id is not null").repartition("function_id")
    # A part is a name more of its parameter, marked by an empty node_id, and goes once names have met nodes.
    is_node = F.col("was").isNull()
    met = rows.withColumn("was", F.col("index")).withColumn("index", F.when(F.col("label").isNotNull(), F.min("was").over(Window.partitionBy("function_id", "label"))))
    # A node serves the first parameter that wants it, a parameter takes its first node.
    met = met.where(is_node | F.col("node_id").isNull()).withColumn("index", F.coalesce("was", "index"))
    met = met.withColumn("first", F.when(F.col("index").isNotNull(), F.min("node_id").over(Window.partitionBy("function_id", "index"))))
    rest = F.when(is_node, F.col("first").isNull() | (F.col("first") != F.col("node_id"))).otherwise(F.col("first").isNull())
    named = met.withColumn("rest", rest).where(F.col("rest") | ~is_node)
    placed = named.withColumn("r", F.when(F.col("rest"), F.row_number().over(Window.partitionBy("function_id", "rest", is_node).orderBy("was", "node_id"))).otherwise(F.col("was")))
    pairs = placed.groupBy("function_id", "rest", "r").agg(F.max("was").alias("index"), F.max(F.when(F.col("rest"), F.col("node_id")).otherwise(F.col("first"))).alias("node_id"))
    return pairs.where("index is not null and node_id is not null").select("function_id", "index", "node_id")


def callees(graph: Graph) -> DataFrame:
    """node_id, callee: of call nodes and call sites, distinct."""
    own = graph.nodes.select(F.col("id").alias("node_id"), F.explode("resolved_callees").alias("callee"))
    return own.unionByName(graph.call_sites.select("node_id", F.explode("callee_ids").alias("callee"))).distinct()


def has_calls(graph: Graph) -> bool:
    return any(not df.where(F.size(c) > 0).isEmpty() for df, c in ((graph.nodes, "resolved_callees"), (graph.call_sites, "callee_ids")))


def wired_callbacks(graph: Graph) -> DataFrame:
    return graph.callback_links.where("param_node_id is not null")


def moves(graph: Graph, bindings: DataFrame, options: SolveOptions) -> DataFrame:
    """Every way a state can go on: src, dst, dst_function, dst_kind, rank (order among one state's moves), next_arg, needs_arg, enters.

    Graph edges come first, by target, kind and position; then arguments into parameters and returns to callers, each only
    where the graph has no edge of its own for it; then callback wiring.
    """
    ends = graph.nodes.select(F.col("id").alias("dst"), F.col("function_id").alias("dst_function"), F.col("kind").alias("dst_kind"))
    begins = graph.nodes.select(F.col("id").alias("src"), F.col("function_id").alias("src_function"), F.col("kind").alias("src_kind"))
    none = F.lit(None)

    def rank(phase: int, a: Column, b: Column, c: Column) -> Column:
        return F.struct(F.lit(phase).alias("phase"), a.alias("a"), b.alias("b"), F.coalesce(c, F.lit(-1)).cast("int").alias("c"))

    # No state is at what isn't a node, so where an edge begins needs no look.
    plain = graph.edges.join(ends, "dst").select("src", "dst", "dst_function", "dst_kind", rank(0, F.col("dst"), F.col("kind"), F.col("arg_index")).alias("rank"), F.when((F.col("kind") == "argument") & F.col("arg_index").isNotNull(), F.col("arg_index")).otherwise(NO_ARG).alias("next_arg"), none.cast("int").alias("needs_arg"), none.cast("string").alias("enters"), F.col("kind").alias("via"))
    if options.scope_function is not None:
        plain = plain.where((F.col("via") != "return") | (F.col("dst_function") == options.scope_function))
    every = plain
    if has_calls(graph):
        every = every.unionByName(_calls(graph, checkpointed(callees(graph)), bindings, begins, ends, rank))
    links = wired_callbacks(graph)
    if not links.isEmpty():
        wired = links.select(F.col("call_node_id").alias("src"), F.col("param_node_id").alias("dst")).distinct().join(ends, "dst")
        every = every.unionByName(wired.select("src", "dst", "dst_function", "dst_kind", rank(3, F.col("dst"), F.lit(""), none).alias("rank"), F.lit(NO_ARG).alias("next_arg"), none.cast("int").alias("needs_arg"), F.col("dst_function").alias("enters"), F.lit("callback").alias("via")))
    return every


def _calls(graph: Graph, calls: DataFrame, bindings: DataFrame, begins: DataFrame, ends: DataFrame, rank: Callable[..., Column]) -> DataFrame:
    """Arguments into parameters and returns to callers, of calls (node_id, callee). The graph's own edges from function to function, most often few, are found first."""
    none = F.lit(None)
    able = graph.edges.join(begins, "src").where("kind = 'argument' or src_kind = 'return'")
    seen, own = Observation(), able.join(ends.select("dst", "dst_function"), "dst").where("src_function <> dst_function").select("src", "dst", (F.col("kind") == "argument").alias("feeds"), (F.col("src_kind") == "return").alias("leaves"))
    own = checkpointed(own.observe(seen, F.count_if("feeds").alias("feeds"), F.count_if("leaves").alias("leaves")))
    without = lambda df, n, rows: df.join(rows.distinct(), rows.columns, "left_anti") if n else df
    free = without(bindings, seen.get["feeds"], own.where("feeds").select(F.col("dst").alias("node_id")))
    # Bindings are of param nodes and know their function.
    into = calls.join(free.select(F.col("node_id").alias("dst"), F.col("function_id").alias("callee"), "index", F.col("function_id").alias("dst_function"), F.lit("param").alias("dst_kind")), "callee")
    arguments = into.select(F.col("node_id").alias("src"), "dst", "dst_function", "dst_kind", rank(1, F.col("callee"), F.lit(""), none).alias("rank"), F.lit(NO_ARG).alias("next_arg"), F.col("index").alias("needs_arg"), F.col("callee").alias("enters"), F.lit("argument").alias("via"))
    returns = without(begins.where("src_kind = 'return'"), seen.get["leaves"], own.where("leaves").select("src")).join(calls.select(F.col("callee").alias("src_function"), F.col("node_id").alias("dst")), "src_function").join(ends, "dst")
    back = returns.select("src", "dst", "dst_function", "dst_kind", rank(2, F.col("dst"), F.lit(""), none).alias("rank"), F.lit(NO_ARG).alias("next_arg"), none.cast("int").alias("needs_arg"), none.cast("string").alias("enters"), F.lit("return").alias("via"))
    return arguments.unionByName(back)


def clearing(sanitizers: DataFrame) -> DataFrame:
    """clear_node, clears: each node's valid sanitisers in order."""
    return sanitizers.where("valid").groupBy(F.col("node_id").alias("clear_node")).agg(F.array_sort(F.collect_list(F.struct("sanitizer_id", "kinds"))).alias("clears"))


#: Fold over a node's sanitisers: what is left, and what each one took.
_FOLD = f"""aggregate(coalesce(clears, array()), named_struct('kinds', kinds, 'uses', cast(array() as {_USE})),
  (s, c) -> named_struct(
    'kinds', if(size(c.kinds) = 0, cast(array() as array<string>), array_except(s.kinds, c.kinds)),
    'uses', if(size(c.kinds) = 0 and size(s.kinds) > 0 or size(array_intersect(s.kinds, c.kinds)) > 0,
      concat(s.uses, array(named_struct('sanitizer_id', c.sanitizer_id, 'kinds', if(size(c.kinds) = 0, s.kinds, array_intersect(s.kinds, c.kinds))))), s.uses)))"""


def _sanitised(rows: DataFrame) -> DataFrame:
    """rows (kinds_key, clears, ...) after their node's sanitisers, with uses; rows without a kind left go. Kinds are taken apart only where something clears."""
    clean = F.col("clears").isNull()
    folded = rows.withColumn("kinds", F.split("kinds_key", JOINED)).withColumn("f", F.when(~clean, F.expr(_FOLD)))
    out = folded.withColumn("kinds_key", F.when(clean, F.col("kinds_key")).otherwise(F.array_join("f.kinds", JOINED))).withColumn("uses", F.when(clean, F.array().cast(_USE)).otherwise(F.col("f.uses")))
    return out.drop("f", "clears", "kinds").where("kinds_key <> ''")


def _first(rows: DataFrame, order: list[str], options: SolveOptions) -> DataFrame:
    """The first arrival of each key. If order doesn't matter and nothing but kinds is carried, numbers are enough, which Spark combines in hash tables."""
    if not options.ordered and not options.max_call_depth:
        return rows.groupBy(*KEY).agg(F.min("parent").alias("parent"), F.min("symbolic").alias("symbolic"))
    held = list(dict.fromkeys([*order, "parent", "symbolic", "entered", "uses"]))
    return rows.groupBy(*KEY).agg(F.min(F.struct(*held)).alias("x")).select(*KEY, *[F.col(f"x.{c}").alias(c) for c in held])


def _numbered(rows: DataFrame, level: int, order: list[str], buckets: int) -> DataFrame:
    """rows in order, if there is one, with level and an increasing seq, dealt out by key."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    ranged = ranged.withColumn("seq", F.monotonically_increasing_id()).withColumn("level", F.lit(level))
    ranged = ranged.select(*KEY, "symbolic", *[c for c in ("entered", "uses") if c in ranged.columns], "parent", "seq", "level")
    return ranged.repartition(buckets, *KEY) if order else ranged


def token(function_id: Column, index: Column) -> Column:
    """The source_id of what a parameter brings."""
    return F.concat(F.lit("param:"), function_id, F.lit("#"), index.cast("string"))


def own_tokens(states: DataFrame) -> DataFrame:
    """Symbolic states in the function whose parameter they are of, with its param_index. A token ends in its index, so nothing is joined."""
    index = F.substring_index("source_id", "#", -1)
    return states.where(F.col("symbolic") & (F.col("source_id") == token(F.col("function_id"), index))).withColumn("param_index", index.try_cast("int"))


def seeds(graph: Graph, sources: DataFrame, clears: DataFrame, bindings: DataFrame, options: SolveOptions) -> DataFrame:
    info = graph.nodes.select(F.col("id").alias("node"), "function_id", F.col("kind").alias("node_kind"))
    real = sources.where(F.size("kinds") > 0).select(
        F.col("node_id").alias("node"), "source_id", normalized(F.col("kinds")).alias("kinds"), F.lit(False).alias("symbolic"),
        F.struct(F.lit(0).alias("phase"), F.col("range.start.line").alias("a"), F.col("range.start.column").alias("b"), F.col("node_id").alias("c"), F.col("source_id").alias("d")).alias("rank"),
    )
    every = real.join(info, "node")
    if options.seed_params:
        # Bindings know their nodes' function.
        marks = bindings.select(F.col("node_id").alias("node"), "function_id", F.lit("param").alias("node_kind"), token(F.col("function_id"), F.col("index")).alias("source_id"), F.array(F.lit(WILDCARD)).alias("kinds"), F.lit(True).alias("symbolic"), F.struct(F.lit(1).alias("phase"), F.lit(0).alias("a"), F.col("index").alias("b"), F.col("function_id").alias("c"), F.lit("").alias("d")).alias("rank"))
        every = every.unionByName(marks)
    met = every.join(clears, F.col("node") == F.col("clear_node"), "left").drop("clear_node")
    rows = _sanitised(met.withColumn("kinds_key", F.array_join("kinds", JOINED)).drop("kinds")).withColumn("arg", F.lit(NO_ARG)).withColumn("entered", F.array().cast("array<string>")).withColumn("parent", F.lit(None).cast("bigint"))
    return _first(rows, ["rank"], options)


@dataclass
class Solution:
    """states: key columns, function_id, node_kind, symbolic, uses, level, seq, parent (seq in the level before), expanded. truncated, capped: function_id of the functions that met a limit. total: how many states there are. uses are those of ordered solutions."""

    states: DataFrame
    truncated: DataFrame
    capped: DataFrame
    rounds: int
    total: int
    bindings: DataFrame


class _Budget:
    """States that functions have had so far, kept up once all states together pass the limit: by groups of functions first, and level by level by function once a group passes the limit."""

    def __init__(self, limit: int):
        self.limit, self.grouped, self.spent, self.late = limit, None, None, []
        # Up to which level groups were counted, how many states there were by then, and how many the largest group had.
        self.level, self.total, self.most = -1, 0, 0

    def _groups_within(self, states: DataFrame, level: int, total: int) -> bool:
        """Whether no group of functions has passed the limit, so that no function of it has. Not asked where groups would pass it on average, nor counted again while the largest group couldn't pass it with all states since."""
        if 2 * total > self.limit * GROUPS:
            return False
        if self.grouped is not None and self.most + total - self.total <= self.limit:
            return True
        rows = states.where((F.col("level") > self.level) & (F.col("level") <= level)).select(F.pmod(F.xxhash64("function_id"), F.lit(GROUPS)).alias("g"), F.lit(1).cast("long").alias("n"))
        seen = Observation()
        self.grouped = checkpointed((rows if self.grouped is None else rows.unionByName(self.grouped)).groupBy("g").agg(F.sum("n").alias("n")).observe(seen, F.max("n").alias("most")))
        self.level, self.total, self.most = level, total, seen.get["most"] or 0
        return self.most <= self.limit

    def over(self, frontier: DataFrame, states: DataFrame, level: int, total: int) -> DataFrame | None:
        """function_id of functions that pass the limit in this level; their states beyond it are noted as late (level, seq)."""
        if self.spent is None and self._groups_within(states, level, total):
            return None
        zero = F.lit(0).cast("long")
        if self.spent is None:
            own = states.where(F.col("level") <= level).select("function_id", (F.col("level") < level).cast("long").alias("past"), (F.col("level") == level).cast("long").alias("now"))
        else:
            own = self.spent.select("function_id", (F.col("past") + F.col("now")).alias("past"), zero.alias("now")).unionByName(frontier.select("function_id", zero.alias("past"), F.lit(1).cast("long").alias("now")))
        seen, tight = Observation(), (F.col("now") > 0) & (F.col("past") + F.col("now") > self.limit)
        self.spent = checkpointed(own.groupBy("function_id").agg(F.sum("past").alias("past"), F.sum("now").alias("now")).observe(seen, F.count_if(tight).alias("n")))
        if not seen.get["n"]:
            return None
        over = self.spent.where(tight)
        # In order of arrival; a function may have any number of states.
        placed = running(frontier.join(over, "function_id").select("function_id", "past", "level", "seq"), ["function_id"], ["seq"], {"r": (F.sum, F.lit(1))})
        self.late.append(checkpointed(placed.where(F.col("r") + F.col("past") > self.limit).select("level", "seq")))
        return over.select("function_id")


def _hubs(ways: DataFrame) -> DataFrame | None:
    """src, parts of nodes with more moves than a bucket is to have of one node; None if there are none. Nothing is shuffled, as moves lie by source node."""
    seen = Observation()
    many = ways.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > HUB_MOVES).select("src", F.ceil(F.col("n") / HUB_MOVES).cast("int").alias("parts"))
    many = checkpointed(many.observe(seen, F.count("*").alias("n")))
    return many if seen.get["n"] else None


def dealt(store: Store, ways: DataFrame) -> tuple[DataFrame, tuple[str, ...], DataFrame | None]:
    """ways in buckets by the key that is returned with them, and the nodes whose moves lie in several."""
    store.append("ways", ways.repartition(store.buckets, "src"), ("src",))
    let_go(store.spark)
    hubs = _hubs(store.table("ways"))
    if hubs is None:
        return store.table("ways"), ("src",), None
    spread = store.table("ways").join(hubs, "src", "left").withColumn("part", F.pmod(F.xxhash64("dst", "next_arg"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    store.append("spread", spread.repartition(store.buckets, "src", "part"), ("src", "part"))
    return store.table("spread"), ("src", "part"), hubs


def towards(go: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """go (src, ...), to every part of its node's moves where they lie in several buckets."""
    return go if hubs is None else go.join(hubs, "src", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def propagate(graph: Graph, occurrences: Occurrences, options: SolveOptions = SolveOptions(), within: DataFrame | None = None) -> Solution:
    """within (node): only these nodes are solved, parameters being seeds only in the function of scope_function."""
    spark = graph.nodes.sparkSession
    bindings = checkpointed(bind_params(graph))
    clears = small(checkpointed(clearing(occurrences.sanitizers)))
    store = Store(spark)
    ways = moves(graph, bindings, options).join(clears.withColumnRenamed("clear_node", "dst"), "dst", "left")
    sources = occurrences.sources
    seeded = bindings
    if within is not None:
        ways = ways.join(within.select(F.col("node").alias("dst")), "dst", "left_semi")
        sources = sources.join(within.select(F.col("node").alias("node_id")), "node_id", "left_semi")
        seeded = bindings.where(F.col("function_id") == options.scope_function).join(within.select(F.col("node").alias("node_id")), "node_id", "left_semi")
    if not options.ordered:
        ways = ways.drop("rank")
    ways, way_key, hubs = dealt(store, ways)
    first, total, truncated, capped, rounds, budget = seeds(graph, sources, clears, seeded, options), 0, [], [], 0, _Budget(options.max_iterations)
    order = ["rank"] if options.ordered else []
    while True:
        level = _numbered(first, rounds, order, store.buckets)
        n_states = store.append("states", level, KEY, "level", **({"entered": F.max(F.size("entered"))} if "entered" in level.columns else {}))
        let_go(spark)
        if not n_states:
            break
        total += n_states
        states = store.table("states")
        carried = ["entered"] if "entered" in states.columns else []
        frontier = go = states.where(F.col("level") == rounds)
        # A function's states beyond the limit, in order of arrival, are seen but not expanded. While all states together are within it, so is each function.
        if total > options.max_iterations and (tight := budget.over(frontier, states, rounds, total)) is not None:
            truncated.append(tight)
            go = frontier.join(budget.late[-1].select("seq"), "seq", "left_anti")
        rounds += 1
        go = go.select(F.col("node").alias("src"), "source_id", "kinds_key", "arg", *carried, "symbolic", F.col("seq").alias("parent"))
        steps = towards(go, hubs).join(ways, list(way_key)).where("needs_arg is null or needs_arg = arg").drop("arg", *way_key)
        if options.max_call_depth > 0:
            deep = F.col("enters").isNotNull() & (F.size(F.filter("entered", lambda x: x == F.col("enters"))) >= options.max_call_depth)
            # Only paths that entered as many can be capped.
            if (store.seen.get("entered") or 0) >= options.max_call_depth:
                capped.append(checkpointed(steps.where((F.size("entered") >= options.max_call_depth) & deep).select(F.col("enters").alias("function_id")).distinct()))
            steps = steps.where(~deep)
        entered = [F.when(F.col("enters").isNull(), F.col("entered")).otherwise(F.concat("entered", F.array("enters"))).alias("entered")] if carried else []
        arrived = steps.select(F.col("dst").alias("node"), "source_id", "kinds_key", F.col("next_arg").alias("arg"), F.col("dst_function").alias("function_id"), F.col("dst_kind").alias("node_kind"), "symbolic", *entered, "parent", "clears", *(["rank"] if options.ordered else []))
        order = ["parent", "rank"] if options.ordered else []
        first = _first(_sanitised(arrived), order, options).join(states.select(*KEY), list(KEY), "left_anti")
    for name in ("ways", "spread"):
        store.drop(name)
    states = store.released("states").withColumn("kinds", F.split("kinds_key", JOINED)).drop("kinds_key")
    if "uses" not in states.columns:
        states = states.withColumns({"entered": F.array().cast("array<string>"), "uses": F.array().cast(_USE)})
    if budget.late:
        late = reduce(DataFrame.unionByName, budget.late).withColumn("late", F.lit(True))
        states = checkpointed(states.join(late, ["level", "seq"], "left").withColumn("expanded", F.col("late").isNull()).drop("late"))
    else:
        states = states.withColumn("expanded", F.lit(True))
    every = lambda parts: reduce(DataFrame.unionByName, parts).distinct() if parts else empty(spark, "nodes").select("function_id")
    return Solution(states, every(truncated), every(capped), rounds, total, bindings)


def propagate_unordered(graph: Graph, occurrences: Occurrences, options: SolveOptions) -> Solution:
    """The states, truncated and capped functions of propagate for those who follow no paths: without order, unless a limit makes the states depend on it.

    Where no move enters a function, depth has nothing to limit, and each level has the same states in any order until a function passes its budget. If one does, all is solved again in order.
    """
    if not has_calls(graph) and wired_callbacks(graph).isEmpty():
        solution = propagate(graph, occurrences, replace(options, ordered=False, max_call_depth=0))
        if solution.truncated.isEmpty():
            return solution
    return propagate(graph, occurrences, options)


def paths(states: DataFrame, ends: DataFrame) -> DataFrame:
    """ends (id, level, seq, ...) with path: array of node and uses from the seed to the end.

    By pointer doubling: a table has each state's ancestor 2^k levels up, made from the one before by one join, while the places known of each path, its last 2^k, get as many before them by another: as many pairs of joins as the greatest
    depth has binary digits. Jump tables are three numbers a state; steps are looked up once, at the end.
    """
    key = ["level", "seq"]
    ends = checkpointed(ends)
    deepest = ends.agg(F.max("level")).first()[0]
    none = F.array().cast(f"array<struct<node:string,uses:{_USE}>>")
    if deepest is None:
        return ends.withColumn("path", none)
    # A place of a path: whose path it is, how far up it is, and its state. The level follows from the end's.
    places = ends.select(F.col("level").alias("end_level"), F.col("seq").alias("end_seq"), F.lit(0).alias("up"), "level", "seq").distinct()
    # Above the deepest end, nothing is on a path.
    jumps = states.where((F.col("level") <= deepest) & (F.col("level") > 0)).select("level", "seq", F.col("parent").alias("to"))
    span = 1
    while span <= deepest:
        jumps = checkpointed(jumps)
        let_go(states.sparkSession)
        higher = places.where(F.col("level") >= span).join(jumps, key).select("end_level", "end_seq", (F.col("up") + span).alias("up"), (F.col("level") - span).alias("level"), F.col("to").alias("seq"))
        places = checkpointed(places.unionByName(higher))
        onward = jumps.select((F.col("level") + span).alias("level"), F.col("seq").alias("to"), F.col("to").alias("next"))
        jumps = jumps.where(F.col("level") >= 2 * span).join(onward, ["level", "to"]).select("level", "seq", F.col("next").alias("to"))
        span *= 2
    steps = places.join(states.select("level", "seq", F.struct("node", "uses").alias("step")), key)
    made = steps.groupBy("end_level", "end_seq").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "step"))).alias("s"))
    made = made.select(F.col("end_level").alias("level"), F.col("end_seq").alias("seq"), F.transform("s", lambda x: x["step"]).alias("path"))
    return ends.join(made, key)
