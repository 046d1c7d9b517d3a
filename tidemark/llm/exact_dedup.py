"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text without its white space is cut into blocks of BLOCK bytes. The distinct blocks of the corpus are sorted and numbered: equal blocks have one integer,
different ones different integers. Then adjacent names are paired and the distinct pairs sorted and numbered in turn, level by level, until each document has
one name. A name of level k stands for one sequence of up to 2^k blocks and for no other, so two texts are equal exactly if their last names and levels are:
identities don't rest on a hash. The 64-bit hash of a block is only the key by which blocks are sorted and found again; the least and the greatest block of
each hash show whether different blocks share it, and those that do are named by their bytes.

Cost: the text is shuffled once, each different block once for each task that read it, as are the pairs of a level, of which there are half as many as of the level before. Names
are joined back to the rows that hold them by sort-merge joins, whose large keys Spark splits, so copies of one text by the million are neither collected nor sent to one task.

Null and empty texts and texts of white space only are equal to each other (one empty block). A very long text is as many rows as it has blocks. Of
equal texts the row with most code points in the original text stays, then the smallest doc_id, a null one last; of rows that agree in these, too (repeated rows), one stays. An empty
table gives an empty result. Other columns than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import BROADCAST_IDS, checkpointed

#: Bytes of a block.
BLOCK = 1024
#: Names of blocks whose hash another block has, too, begin here; in place of a pair's missing second name stands -1.
SHARED = 1 << 62
_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text's bytes without the characters of [\\x20\\x09-\\x0D]; a null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _SPACE, "").cast("binary")


def _blocks(norm: Column, size: int) -> Column:
    """Bytes as blocks, one empty block if there are none. The bytes are bound to a name, so that they are made once and not for each block."""
    places = lambda t: F.sequence(F.lit(0), F.floor((F.greatest(F.octet_length(t), F.lit(1)) - 1) / size).cast("int"))
    return F.transform(F.array(norm), lambda t: F.transform(places(t), lambda i: t.substr(i * size + 1, F.lit(size))))[0]


def _hash(block: Column) -> Column:
    return F.xxhash64(block)


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """distinct with name: its place in the sorted partitions."""
    return checkpointed(distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id()))


def _block_names(blocks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """blocks (h, block) -> names of hashes that one block has (h, name), and of blocks that share theirs (h, block, name), None if there are none."""
    ends = blocks.groupBy("h").agg(F.min("block").alias("low"), F.max("block").alias("high")).select("h", (F.col("low") == F.col("high")).alias("sole"))
    names = _numbered(ends, "h")
    shared = names.where("not sole").select("h")
    sole = names.where("sole").select("h", "name")
    if shared.isEmpty():
        return sole, None
    return sole, _numbered(blocks.join(_few(shared), "h").select("h", "block").distinct(), "h", "block").withColumn("name", F.lit(SHARED) + F.col("name"))


def _few(hashes: DataFrame) -> DataFrame:
    return F.broadcast(hashes) if hashes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else hashes


def identities(rows: DataFrame, block: int = BLOCK, block_hash=_hash) -> tuple[DataFrame, DataFrame]:
    """rows (row, doc_id, text), row being unique, give (row, level, name), by which texts are equal, and (row, doc_id, n_points, text_sha256)."""
    texts = rows.withColumn("norm", normalised(F.col("text")))
    sole, shared = _block_names(texts.select(F.explode(_blocks(F.col("norm"), block)).alias("block")).select(block_hash(F.col("block")).alias("h"), "block"))
    facts = texts.select("row", "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_points"), F.sha2("norm", 256).alias("text_sha256"), _blocks(F.col("norm"), block).alias("blocks"))
    # A document's facts go with its first block.
    first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    held = facts.select("row", "doc_id", "n_points", "text_sha256", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    held = held.select("row", F.col("pos").cast("long").alias("pos"), "n", first("doc_id"), first("n_points"), first("text_sha256"), block_hash(F.col("block")).alias("h"), *(["block"] if shared else []))
    if shared:
        both = held.join(_few(shared.select("h").distinct().withColumn("many", F.lit(True))), "h", "left")
        held = both.withColumn("block", F.when(F.col("many"), F.col("block"))).drop("many")
    held = checkpointed(held)
    if shared:
        named = held.where("block is null").join(sole, "h").drop("block").unionByName(held.where("block is not null").join(shared, ["h", "block"]).drop("block"))
    else:
        named = held.join(sole, "h")
    level, done = 0, []
    here = checkpointed(named.select("row", "pos", "n", "name"))
    while True:
        done.append(here.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        left = here.where("n > 1")
        if left.isEmpty():
            break
        # n is the same for all names of a document, and so goes to half of them, the odd one counted.
        of = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = left.groupBy("row", F.expr("pos div 2").alias("pos"), F.expr("cast((n + 1) div 2 as int)").alias("n")).agg(of(0).alias("a"), F.coalesce(of(1), F.lit(-1)).alias("b"))
        pairs = checkpointed(pairs)
        names = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        here = checkpointed(pairs.join(names, ["a", "b"]).select("row", "pos", "n", "name"))
        level += 1
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return every, held.where("pos = 0").select("row", "doc_id", "n_points", "text_sha256")


def classes(rows: DataFrame, block: int = BLOCK, block_hash=_hash) -> DataFrame:
    """rows (row, doc_id, text) -> row, doc_id, n_points, text_sha256, group_size, keep_row and keep_id (the row that stays and its doc_id)."""
    names, facts = identities(rows, block, block_hash)
    known = checkpointed(names.join(facts, "row"))
    best = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    # Read from a checkpoint, groups are no part of the join's stage, so that Spark can split a large group's rows.
    groups = checkpointed(known.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(best).alias("best")))
    return known.join(groups, ["level", "name"]).select("row", "doc_id", "n_points", "text_sha256", "group_size", F.col("best.row").alias("keep_row"), F.col("best.doc_id").alias("keep_id"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def exact_digest(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row for each: doc_id, keep_id, group_size, kept, text_sha256."""
    return classes(_rows(docs)).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay."""
    own = checkpointed(docs.select(F.monotonically_increasing_id().alias("_row"), *(F.col(f"`{c}`") for c in docs.columns)))
    stay = classes(own.select(F.col("_row").alias("row"), "doc_id", "text")).where("row = keep_row").select(F.col("row").alias("_row"))
    return own.join(stay, "_row", "left_semi").drop("_row")


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
