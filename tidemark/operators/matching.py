"""Rules meet expressions: dotted-chain patterns, specificity, annotation.

Expressions are rows with segments (array of strings or null), identifier, last (last segment), is_call, dynamic segments being `*`.
Rules are rows with id, ord, member, identifier, call, allow_dynamic. All conditions of a rule must hold; a rule without one matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.operators.running import running
from tidemark.operators.trie import ANY, rule_hits, segments_of
from tidemark.plans.model import checkpointed


def _pairwise(expression: Column, pattern: Column, allow_dynamic: Column | bool) -> Column:
    allow_dynamic = F.lit(allow_dynamic) if isinstance(allow_dynamic, bool) else allow_dynamic

    def fits(e: Column, p: Column) -> Column:
        return F.when(e == ANY, (p == ANY) | allow_dynamic).otherwise((p == ANY) | (e == p))

    return F.forall(F.zip_with(expression, pattern, lambda e, p: F.coalesce(fits(e, p), F.lit(False))), lambda x: x)


def prefix_matches(segments: Column, pattern: Column, allow_dynamic: Column | bool = False) -> Column:
    """The pattern's segments begin the chain, segment by segment."""
    n = F.size(pattern)
    return (F.size(segments) >= n) & (n > 0) & _pairwise(F.slice(segments, F.lit(1), F.greatest(n, F.lit(0))), pattern, allow_dynamic)


def suffix_matches(segments: Column, pattern: Column, allow_dynamic: Column | bool = False) -> Column:
    """The pattern's segments end the chain."""
    n = F.size(pattern)
    start = F.greatest(F.size(segments) - n + 1, F.lit(1))
    return (F.size(segments) >= n) & (n > 0) & _pairwise(F.slice(segments, start, F.greatest(n, F.lit(0))), pattern, allow_dynamic)


def member_matches(segments: Column, member: Column, allow_dynamic: Column) -> Column:
    parts = segments_of(member)
    return F.coalesce(F.when(member.startswith("."), suffix_matches(segments, parts, allow_dynamic)).otherwise(prefix_matches(segments, parts, allow_dynamic)), F.lit(False))


def rule_matches(expression: str = "e", rule: str = "r") -> Column:
    e, r = (lambda c: F.col(f"{expression}.{c}")), (lambda c: F.col(f"{rule}.{c}"))
    member = r("member").isNull() | member_matches(e("segments"), r("member"), F.coalesce(r("allow_dynamic"), F.lit(False)))
    identifier = r("identifier").isNull() | F.coalesce(e("identifier") == r("identifier"), F.lit(False))
    call = r("call").isNull() | (F.coalesce(e("is_call"), F.lit(False)) & F.coalesce(F.coalesce(e("last"), e("identifier")) == r("call"), F.lit(False)))
    given = r("member").isNotNull() | r("identifier").isNotNull() | r("call").isNotNull()
    return given & member & identifier & call


def specificity() -> Column:
    """A rule's rank: segments of its member, then lengths of member, identifier and call."""
    length = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    return F.struct(F.when(F.col("member").isNull(), 0).otherwise(F.size(segments_of(F.col("member")))).alias("segments"), length("member").alias("member"), length("identifier").alias("identifier"), length("call").alias("call"))


def matched(expressions: DataFrame, rules: DataFrame) -> DataFrame:
    """All pairs of node_id and rule columns that match, as rule_matches has it, with spec; expressions walk the rules' trie."""
    return rule_hits(expressions, rules).withColumn("spec", specificity())


def most_specific(matches: DataFrame) -> DataFrame:
    """One rule a node: highest specificity, then declared first."""
    w = Window.partitionBy("node_id").orderBy(F.desc("spec"), "ord")
    return matches.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def all_most_specific(matches: DataFrame) -> DataFrame:
    """Every rule tied at a node's highest specificity."""
    w = Window.partitionBy("node_id").orderBy(F.desc("spec"))
    return matches.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def within_functions(allowed: Column, function_id: Column, name: Column, class_name: Column) -> Column:
    """Whether a source may be in a function: any of its name, id, Class.name, Class::name or what follows a `::` in its id is allowed; no list, or an empty one, allows all."""
    parts = F.split(function_id, "::")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))
    names = F.array_compact(F.concat(F.array(name, F.concat(class_name, F.lit("."), name), F.concat(class_name, F.lit("::"), name)), tails))
    return allowed.isNull() | (F.size(allowed) == 0) | F.arrays_overlap(allowed, names)


def validated(validation: Column, is_call: Column, args: Column) -> tuple[Column, Column]:
    """valid and the reason if not: static-sql wants a literal first argument, constant-argument a constant one."""
    first = F.when(F.size(args) > 0, F.element_at(args, 1))
    reason = (
        F.when(F.coalesce(validation, F.lit("none")) == "none", F.lit(None).cast("string"))
        .when(~is_call, F.lit("not a call"))
        .when(first.isNull(), F.lit("no arguments"))
        .when((validation == "static-sql") & ~is_literal(first), F.lit("first argument is not a literal"))
        .when((validation == "constant-argument") & ~is_constant(first), F.lit("first argument is not constant"))
    )
    return reason.isNull(), reason


def is_literal(text: Column) -> Column:
    """A quoted string or a template without interpolation, in up to eight pairs of parentheses."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?:\(\s*){1,8}(?=[\"'`])", ""), r"(?<=[\"'`])(?:\s*\)){1,8}$", "")
    return bare.rlike(r"""^(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\$]|\\.|\$(?!\{))*`)$""")


def is_constant(text: Column) -> Column:
    """A literal, a number, or true, false, null, undefined."""
    return is_literal(text) | F.trim(text).rlike(r"^[+-]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)$|^(?:true|false|null|undefined)$")


def tainted_args(explicit: Column, args: Column) -> Column:
    """A rule's list, else all positions parsed, else none (any)."""
    return F.coalesce(explicit, F.when(F.size(args) > 0, F.sequence(F.lit(0), F.size(args) - 1)).otherwise(F.array().cast("array<int>")))


def harvested_aliases(texts: DataFrame) -> DataFrame:
    """texts (scope, seq, text) -> scope, name, chain: `x = require('m')` and `{a, b: c} = require('m')`; in a scope the last one wins."""
    simple = r"(?:^|[\s;,])(?:const\s+|let\s+|var\s+)?([A-Za-z_$][\w$]*)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"
    parts = r"\{([^}]*)\}\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"
    module = lambda c: F.regexp_replace(F.regexp_extract(c, r"^((?:@[^/]+/)?[^/]+)", 1), r"^node:", "")
    one = texts.where(F.col("text").rlike(simple)).select("scope", "seq", F.regexp_extract("text", simple, 1).alias("name"), module(F.regexp_extract("text", simple, 2)).alias("chain"))
    many = texts.where(F.col("text").rlike(parts)).select("scope", "seq", module(F.regexp_extract("text", parts, 2)).alias("m"), F.explode(F.split(F.regexp_extract("text", parts, 1), ",")).alias("p"))
    many = many.where(F.trim("p") != "").select("scope", "seq", F.trim(F.element_at(F.split("p", ":"), -1)).alias("name"), F.concat("m", F.lit("."), F.trim(F.element_at(F.split("p", ":"), 1))).alias("chain"))
    return one.unionByName(many).groupBy("scope", "name").agg(F.max_by("chain", F.struct("seq", "chain")).alias("chain"))


def resolved_aliases(aliases: DataFrame, hops: int = 8) -> DataFrame:
    """scope, name -> full: the chain whose first segment is no alias any more, after so many hops at most; a cycle stops where it began to repeat.

    A hop is a plan of its own, for the chains that went on in the one before; most stand for no alias, so that one plan is all.
    """
    out, done = aliases.select("scope", "name", F.col("chain").alias("full"), F.array("name").alias("seen")), []
    step = aliases.select("scope", F.col("name").alias("root"), F.col("chain").alias("next"))
    for _ in range(hops - 1):
        on = out.withColumn("root", F.substring_index("full", ".", 1)).join(step, ["scope", "root"], "left")
        seen, go = Observation(), F.coalesce(F.col("next").isNotNull() & ~F.array_contains("seen", F.col("root")), F.lit(False))
        on = checkpointed(on.withColumn("go", go).observe(seen, F.count_if("go").alias("n")))
        done.append(on.where("not go").select("scope", "name", "full"))
        if not seen.get["n"]:
            return reduce(DataFrame.unionByName, done)
        out = on.where("go").select("scope", "name", F.concat("next", F.expr("substring(full, length(root) + 1)")).alias("full"), F.concat("seen", F.array("root")).alias("seen"))
    return reduce(DataFrame.unionByName, [*done, out.select("scope", "name", "full")])


def as_of_declaration(uses: DataFrame, declarations: DataFrame) -> DataFrame:
    """uses (scope, name, pos) -> decl: the latest declaration (start, end, decl) of the name that ends at or before the use, else the earliest."""
    order = F.struct("start", "decl")
    made = declarations.select("scope", "name", F.col("end").alias("at"), F.lit(0).alias("use"), order.alias("o"))
    used = uses.select("scope", "name", F.col("pos").alias("at")).distinct().withColumn("use", F.lit(1)).withColumn("o", F.lit(None))
    # A running maximum in order of position, in two levels: a name's uses and declarations never meet as pairs, and a name of any number of them is many tasks' work.
    reached = running(made.unionByName(used), ["scope", "name"], ["at", "use"], {"before": (F.max, F.col("o"))}).where("use = 1")
    first = declarations.groupBy("scope", "name").agg(F.min(order).alias("first"))
    return reached.join(first, ["scope", "name"]).select("scope", "name", F.col("at").alias("pos"), F.coalesce("before.decl", "first.decl").alias("decl"))
