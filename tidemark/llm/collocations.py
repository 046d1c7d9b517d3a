"""Phrases whose words keep company, mined by growing contiguous patterns from projected occurrences, as PrefixSpan does.

Frequent words are counted first, then frequent pairs of them. Each frequent pair is a prefix: its occurrences are projected to pointers, which are the words that follow,
up to five in all and only as far as neighbouring words are frequent pairs. Pointers are dealt out by prefix, one task for each, and sorted; in that order all pointers of a prefix lie together, those of
each of its extensions within them, and so on, so a task that walks down its sorted pointers extends to the right depth first, holding no more than the prefixes that it is in. Frequent
phrases come out as their pointers end.

A prefix with more than 1/HOT_SHARE of all words has its pointers dealt by its next word, and again while the next pair is such a prefix; the counts of the
prefix itself are then sums over tasks. Equal pointers of one step are one row with a count, so neither a common phrase nor a third of all documents being one text makes a large task.

What the tasks know of frequent words and pairs is a bit map of at most FILTER_BITS bits (16 MB), and at most HOT_SHARE keys of hot pairs: bounded whatever the corpus. A bit map that is too small lets more
pointers through, which then turn out infrequent; it never loses one. Words are told apart by 64-bit hashes under a seed; counting compares the words behind each frequent hash, and if two differ, all begins again with another seed: counts are exact.

Scores are exact: products are decimals of 38 digits (n below 10^17, counts below 10^15). Null texts are empty, a null lang is `und`. Ties are ranked as stated in `ranked`. A very long text is read in steps that overlap by four words. An
empty table gives an empty result, repeated rows count as often as they stand. Columns but text and lang are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import checkpointed, forget_shuffles, text_slices, utf8
from tidemark.llm.shingles import mixed

LONGEST = 5
LEAST = 100
TOP = 2000
#: Pairs with more than this share of all words are hot; there are fewer than so many.
HOT_SHARE = 10_000
FILTER_BITS = 1 << 27
#: UTF-8 bytes of text that are counted together; words that a task holds with their counts.
STEP_BYTES = 4 << 20
HELD_WORDS = 300_000
#: Groups that a language's phrases are ranked in before the last ranking.
RANK_GROUPS = 64

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_DOT = bytes.maketrans(_BREAKS, b"." * len(_BREAKS))
_ENDS = re.compile(rb"[.,;:!?\x09-\x0d ]")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
WORDS = [f"w{k + 1}" for k in range(LONGEST)]


class Hashes(dict):
    """Word to a 64-bit hash, never 0; the break between pieces, which no word can be, to 0. Forgets all when it holds many words."""

    def __init__(self, seed: int, most: int = 400_000):
        self.seed, self.most = seed, most
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self[b"."] = 0
        self[word] = h = self.hashed(word)
        return h

    def hashed(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word, self.seed) or 1

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words, and `.` where a piece ends."""
    return data.lower().translate(_TO_DOT).replace(b".", b" . ").split()


def _cuts(data: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """A long text in steps that end between words, each with whether it is the last."""
    begin = 0
    while len(data) - begin > size:
        end = _ENDS.search(data, begin + size)
        if not end:
            break
        yield data[begin : end.start()], False
        begin = end.start()
    yield data[begin:], True


def word_steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes], bool]]:
    """lang, words, and whether the words that follow belong to other texts."""
    for part in text_slices(batches, "text", size):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), utf8(part), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for data, last in _cuts(b" . ".join(texts), 2 * size):
                yield lang, words_of(data), last


def hash_steps(batches: Iterator[pa.RecordBatch], size: int, hashes: Hashes) -> Iterator[tuple[str, np.ndarray, int]]:
    """lang, hashes, and at how many of the first a phrase may begin here; those after them begin the next step."""
    rest = np.zeros(0, np.uint64)
    for lang, words, last in word_steps(batches, size):
        h = np.concatenate([rest, hashes.of(words)])
        own = len(h) if last else max(len(h) - LONGEST + 1, 0)
        rest = h[own:]
        yield lang, h, own


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ ((b << np.uint64(21)) | (b >> np.uint64(43)))


def _sql_pair_key(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.shiftleft(b, 21).bitwiseOR(F.shiftrightunsigned(b, 43)))


class Bits:
    """Keys that may be in a table, by their low bits."""

    def __init__(self, size: int, chunks: list[tuple[int, bytes]]):
        self.mask, self.bytes = np.uint64(size - 1), np.zeros(size // 8, np.uint8)
        for k, data in chunks:
            self.bytes[4096 * k : 4096 * (k + 1)] = np.frombuffer(data, np.uint8)

    def have(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_map(keys: DataFrame, most: int = FILTER_BITS) -> Bits:
    """keys (key bigint) as bits, 16 for each key, most at most; only the map comes to the driver."""
    size, n = 1 << 15, keys.count()
    while size < min(16 * n, most):
        size *= 2
    at = F.col("key").bitwiseAND(F.lit(size - 1))
    chunks = keys.groupBy(F.shiftright(at, 15).alias("chunk")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    return Bits(size, [(r["chunk"], bytes(r["bits"])) for r in chunks])


def _totals(key: np.ndarray, columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows once, with how often they stand; key sorts equal rows together."""
    order = np.argsort(key)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def _batch(lang: str, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int32))), *arrays], names=["lang", *columns])


def count_words(docs: DataFrame, seed: int, least: int) -> DataFrame:
    """docs (lang, text) -> lang, h, f, low, high: words by hash, found least times or more; h 0 stands for all words of the lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Hashes(seed), {}

        def flushed():
            for lang, counter in held.items():
                words, c = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
                h = np.fromiter((hashes.hashed(w) if w else 0 for w in words), np.uint64, len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(h.view(np.int64)), pa.array(words, pa.binary()), pa.array(c)], names=["lang", "h", "word", "c"])
            held.clear()

        for lang, words, _ in word_steps(batches, STEP_BYTES):
            counter = held.setdefault(lang, Counter())
            counter.update(words)
            counter[b""] += len(words) - counter.pop(b".", 0)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from flushed()
        yield from flushed()

    found = docs.mapInArrow(run, "lang string, h long, word binary, c long")
    return checkpointed(found.groupBy("lang", "h").agg(F.sum("c").alias("f"), F.min("word").alias("low"), F.max("word").alias("high")).where((F.col("h") == 0) | (F.col("f") >= least)))


def count_pairs(docs: DataFrame, seed: int, least: int, frequent) -> DataFrame:
    """docs (lang, text) -> lang, w1, w2, f: pairs of words of the bit map, found least times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = frequent.value, Hashes(seed)
        for lang, h, own in hash_steps(batches, STEP_BYTES, hashes):
            ok = (h != 0) & bits.have(h)
            at = np.flatnonzero(ok[:-1] & ok[1:])
            at = at[at < own]
            a, b = h[at], h[at + 1]
            (a, b), c = _totals(pair_key(a, b), [a, b])
            yield _batch(lang, {"w1": a, "w2": b, "c": c})

    found = docs.mapInArrow(run, "lang string, w1 long, w2 long, c long")
    return checkpointed(found.groupBy("lang", "w1", "w2").agg(F.sum("c").alias("f")).where(F.col("f") >= least))


def pointers(h: np.ndarray, own: int, words: Bits, pairs: Bits, hot: np.ndarray) -> dict[str, np.ndarray]:
    """Occurrences of prefixes with what follows: w1 to w5 (0 where nothing does), cold, deal, c.

    cold is the number of words up to the first pair that isn't hot, LONGEST + 1 if all are: so many words are dealt by, or all that are there.
    """
    ok = (h != 0) & words.have(h)
    at = np.flatnonzero(ok[:-1] & ok[1:])
    key = pair_key(h[at], h[at + 1])
    good = pairs.have(key)
    at, key = at[good], key[good]
    linked, heated = np.zeros(len(h) + LONGEST, bool), np.zeros(len(h) + LONGEST, bool)
    linked[at] = True
    heated[at] = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else False
    begin = np.flatnonzero(linked[: len(h)] & linked[1 : len(h) + 1])
    begin = begin[begin < own]
    padded = np.append(h, np.zeros(LONGEST, np.uint64))
    columns, there, cold = [], np.ones(len(begin), bool), np.full(len(begin), LONGEST + 1, np.int64)
    deal, dealt = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    for k in range(LONGEST):
        if k:
            there = there & linked[begin + k - 1]
            cold[there & ~heated[begin + k - 1] & (cold > k + 1)] = k + 1
        w = np.where(there, padded[begin + k], np.uint64(0))
        columns.append(w)
        dealt = dealt + w * _ODD[k]
        deal = np.where(cold >= k + 1, dealt, deal)
    found, c = _totals(dealt, [*columns, cold, deal])
    return dict(zip([*WORDS, "cold", "deal", "c"], [*found, c], strict=True)) | {"deal": mixed(found[-1])}


class Growth:
    """Counts of prefixes of three words and more along sorted pointers; per length only the last prefix waits for more."""

    def __init__(self, least: int):
        self.least, self.waiting = least, {}

    def _out(self, k: int, lang, words, cold, f) -> pa.RecordBatch:
        """Prefixes that no other task has pointers of are counted in full, and go if they are infrequent."""
        stay = (f >= self.least) | (cold > k)
        columns = [words[stay, j] if j < k else np.zeros(int(stay.sum()), np.int64) for j in range(LONGEST)]
        return pa.RecordBatch.from_arrays([pa.array(lang[stay], pa.string()), *map(pa.array, columns), pa.array(f[stay])], names=["lang", *WORDS, "c"])

    def add(self, lang: np.ndarray, words: np.ndarray, cold: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(3, LONGEST + 1):
            here = np.flatnonzero(words[:, k - 1] != 0)
            if not len(here):
                continue
            own = (lang[here], words[here, :k], cold[here], c[here])
            if k in self.waiting:
                own = tuple(np.concatenate([a, b]) for a, b in zip(self.waiting[k], own, strict=True))
            new = np.ones(len(own[0]), bool)
            new[1:] = (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]).any(axis=1)
            first = np.flatnonzero(new)
            f = np.add.reduceat(own[3], first)
            rows = own[0][first], own[1][first], own[2][first], f
            self.waiting[k] = tuple(x[-1:] for x in rows)
            if len(first) > 1:
                yield self._out(k, *(x[:-1] for x in rows))

    def ended(self) -> Iterator[pa.RecordBatch]:
        for k, rows in self.waiting.items():
            yield self._out(k, *rows)


def grown(docs: DataFrame, seed: int, least: int, words, pairs, hot) -> DataFrame:
    """docs (lang, text) -> lang, w1 to w5, f: phrases of three words and more found least times or more."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(seed)
        for lang, h, own in hash_steps(batches, STEP_BYTES, hashes):
            yield _batch(lang, pointers(h, own, words.value, pairs.value, hot.value))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growth = Growth(least)
        for b in batches:
            column = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            yield from growth.add(column("lang"), np.stack([column(w) for w in WORDS], axis=1), column("cold"), column("c"))
        yield from growth.ended()

    longs = ", ".join(f"{w} long" for w in WORDS)
    dealt = docs.mapInArrow(project, f"lang string, {longs}, cold long, deal long, c long").repartition("lang", "deal").sortWithinPartitions("lang", *WORDS)
    return dealt.select("lang", *WORDS, "cold", "c").mapInArrow(grow, f"lang string, {longs}, c long").groupBy("lang", *WORDS).agg(F.sum("c").alias("f")).where(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, least: int = LEAST, hot_share: int = HOT_SHARE, hash_seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (text, lang) -> phrases (lang, w1 to w5, 0 after the last word, f), words (lang, h, word) and totals (lang, n)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    seed = hash_seed
    while True:
        counted = count_words(docs, seed, least)
        # Each count's shuffle is as large as its distinct words or phrases; nothing refers to it now that the count is in a checkpoint.
        forget_shuffles(spark)
        words, totals = counted.where("h <> 0"), counted.where("h = 0").select("lang", F.col("f").alias("n"))
        if words.where("low <> high").isEmpty():
            break
        seed += 1
    share = lambda x: spark.sparkContext.broadcast(x)
    word_bits = share(bit_map(words.select(F.col("h").alias("key"))))
    pairs = count_pairs(docs, seed, least, word_bits)
    forget_shuffles(spark)
    every = totals.agg(F.sum("n")).first()[0] or 0
    key = _sql_pair_key("w1", "w2").alias("key")
    pair_bits = share(bit_map(pairs.select(key)))
    # Fewer than hot_share pairs can have more than such a share of all words.
    hot = share(np.sort(np.array([r["key"] for r in pairs.where(F.col("f") * hot_share > every).select(key).collect()], np.int64).view(np.uint64)))
    longer = grown(docs, seed, least, word_bits, pair_bits, hot)
    padded = lambda df, given: df.select("lang", *[F.col(given[k]).alias(w) if k < len(given) else F.lit(0).cast("long").alias(w) for k, w in enumerate(WORDS)], "f")
    phrases = checkpointed(padded(words, ["h"]).unionByName(padded(pairs, ["w1", "w2"])).unionByName(longer))
    del longer
    forget_shuffles(spark)
    return phrases, words.select("lang", "h", F.col("low").alias("word")), totals


def _part(begin: int, end: Column, side: str) -> list[Column]:
    """Words begin to end - 1 as w1 to w5 of a part; begin is a number, end a column."""
    at = lambda k: F.col(WORDS[k]) if k < LONGEST else F.lit(0).cast("long")
    return [F.when(F.lit(begin + k) < end, at(begin + k)).otherwise(F.lit(0).cast("long")).alias(f"{side}{k + 1}") for k in range(LONGEST)]


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, w1 to w5, a, l, r, n, score of phrases of two words and more that are in no longer one as often; the cut with the lowest score counts, of equal ones the first."""
    sized = phrases.withColumn("size", sum((F.col(w) != 0).cast("int") for w in WORDS))
    several = sized.where("size > 1")
    longer = several.where("size > 2")
    # A phrase that a much longer one holds as often is held as often by one that is a word longer.
    inner = longer.select("lang", "f", *_part(0, F.col("size") - 1, "w")).unionByName(longer.select("lang", "f", *_part(1, F.col("size"), "w")))
    left = checkpointed(several.join(inner, ["lang", *WORDS, "f"], "left_anti").withColumnRenamed("f", "a"))
    cuts = F.array_compact(F.array(*[F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), *_part(0, F.lit(k), "l"), *_part(k, F.col("size"), "r"))) for k in range(1, LONGEST)]))
    cut = left.select("lang", *WORDS, "a", F.explode(cuts).alias("cut")).select("lang", *WORDS, "a", "cut.*")
    for side in "lr":
        cut = cut.join(phrases.select("lang", *[F.col(w).alias(f"{side}{k + 1}") for k, w in enumerate(WORDS)], F.col("f").alias(side)), ["lang", *[f"{side}{k + 1}" for k in range(LONGEST)]])
    score = F.expr("cast(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)")
    best = cut.join(totals, "lang").withColumn("score", score).groupBy("lang", *WORDS, "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", *WORDS, "a", "x.l", "x.r", "n", "x.score")


def ranked(found: DataFrame, words: DataFrame, top: int = TOP) -> DataFrame:
    """Each lang's first phrases by score and a, both descending, then by the phrase's bytes: lang, rank, phrase, a, l, r, n, score.

    They are ranked in groups first, as a language may have any number of them; words are looked up for those that may still be among the first.
    """
    grouped = found.withColumn("g", F.pmod(F.xxhash64(*WORDS), F.lit(RANK_GROUPS)))
    order = [F.desc("score"), F.desc("a")]
    near = checkpointed(grouped.withColumn("x", F.rank().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("x") <= top).drop("x"))
    each = near.select("lang", *WORDS, F.posexplode(F.array(*WORDS)).alias("pos", "h")).where("h <> 0").join(words, ["lang", "h"])
    spelt = each.groupBy("lang", *WORDS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("word").cast("string").alias("word")))), lambda x: x["word"]), " ").alias("phrase"))
    rows = near.join(spelt, ["lang", *WORDS])
    for group in (["lang", "g"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, hot_share: int = HOT_SHARE) -> DataFrame:
    """docs (text, lang) -> lang, rank, phrase, a, l, r, n, score."""
    phrases, words, totals = frequent_phrases(docs, least, hot_share)
    return ranked(scored(phrases, totals), words, top)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""WITH pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
f AS (SELECT lang, p, len(p) AS size, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS p FROM w, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE len(w) >= k) GROUP BY lang, p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, p, size, f AS a FROM f WHERE size > 1 AND f >= {LEAST}),
longer AS (SELECT DISTINCT lang, a, p[b : b + s - 1] AS p FROM c, unnest(range(2, 5)) AS x(s), unnest(range(1, 5)) AS y(b) WHERE s < size AND b + s - 1 <= size),
k AS (SELECT * FROM c ANTI JOIN longer USING (lang, p, a)),
cut AS (SELECT k.lang, k.p, a, k, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM k JOIN unnest(range(1, 5)) AS x(k) ON k < size JOIN f l ON l.lang = k.lang AND l.p = k.p[1 : k] JOIN f r ON r.lang = k.lang AND r.p = k.p[k + 1 :] JOIN n ON n.lang = k.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
done AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM best)
SELECT * FROM done WHERE rank <= {TOP}"""
