"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Short items hide in long documents, so whole-document sketches would compare sets of too different sizes. Items are
partitioned by size into classes [2^k, 2^(k+1)) shingles. For a class, every document is covered by windows of 3 * 2^k shingles
that begin every 2^k: a passage of an item's length lies within one of them, and a window that holds four fifths of an item has
Jaccard similarity 1/4 at least with it. One agreement among HASHES minima makes a candidate; a window with 1/4 misses all of them with
probability (3/4)^64 = 1e-8. Items of under 8 shingles are sketched by all their shingles. A candidate document is then held
against the item over its whole text, shingle by shingle.

An item of fewer than five words is one shingle, its whole sequence, and is found in a document that is that sequence. Null and
empty items match nothing, null and empty documents contain nothing. Items are the stated query set: they go to all tasks
in blocks of BLOCK_ITEMS, whose size is bounded, and blocks run one after the other. Rows that repeat a doc_id or item_id give one row for each pair of ids,
with the larger containment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import text_slices, utf8, without_ids
from tidemark.llm.shingles import WORDS, WordHashes, shingle_set, shingles

HASHES = 64
SMALLEST_CLASS = 3
BLOCK_ITEMS = 5_000
#: Share of an item's shingles that a document must hold, in fifths: 0.8.
FIFTHS = 4

_rng = np.random.default_rng(977)
_MASKS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_MAX = np.uint64((1 << 64) - 1)
#: Places in a block's bit maps for each key, as a power of two.
_FILTER_SPREAD = 8


def exact_shingles(data: bytes) -> set[bytes]:
    words = data.lower().split()
    if not words:
        return set()
    return {b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}


@dataclass
class _Keys:
    """Sorted keys with the items that have them, and a map that turns most others away: it grows with the keys and is made anew in each task, not sent there."""

    keys: np.ndarray
    items: np.ndarray
    seen: np.ndarray
    shift: np.uint64

    @staticmethod
    def of(keys: np.ndarray, items: np.ndarray) -> _Keys:
        order = np.argsort(keys, kind="stable")
        bits = len(keys).bit_length() + _FILTER_SPREAD
        shift = np.uint64(64 - bits)
        seen = np.zeros(1 << bits, bool)
        seen[keys >> shift] = True
        return _Keys(keys[order], items[order], seen, shift)

    def __reduce__(self):
        return _Keys.of, (self.keys, self.items)

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in values and items with that key, all pairs."""
        at = np.flatnonzero(self.seen[values >> self.shift])
        begin, end = np.searchsorted(self.keys, values[at], "left"), np.searchsorted(self.keys, values[at], "right")
        n = end - begin
        where = np.repeat(at, n)
        return where, self.items[np.repeat(begin, n) + np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)]


class ItemIndex:
    """Sketches of a block of items, by size class."""

    def __init__(self, items: list[tuple[int, bytes]]):
        hashes = WordHashes()
        self.ids = [i for i, _ in items]
        self.exact = [frozenset(exact_shingles(x)) for _, x in items]
        sets = [shingle_set(x, hashes) for _, x in items]
        tiny = [i for i, s in enumerate(sets) if 0 < len(s) < 1 << SMALLEST_CLASS]
        self.tiny = _Keys.of(np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in tiny)]), np.repeat(np.array(tiny, int), [len(sets[i]) for i in tiny]))
        self.classes: dict[int, list[_Keys]] = {}
        for k in sorted({len(s).bit_length() - 1 for s in sets if len(s) >= 1 << SMALLEST_CLASS}):
            own = [i for i, s in enumerate(sets) if len(s).bit_length() - 1 == k]
            self.classes[k] = [_Keys.of(np.array([((sets[i] ^ _MASKS[h]) * _FACTORS[h]).min() for i in own], np.uint64), np.array(own)) for h in range(HASHES)]

    def candidates(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, item) pairs that share a minimum in some window, or a shingle of a tiny item."""
        lengths = np.array([len(x) for x in texts], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *texts])
        text_of = np.repeat(np.arange(len(texts)), lengths)
        if not len(every):
            return set()
        where, items = self.tiny.hits(every)
        found = set(zip(text_of[where].tolist(), items.tolist(), strict=True))
        layout = {}
        begins = np.cumsum(lengths) - lengths
        for k in self.classes:
            blocks = -(-lengths >> k)
            owner = np.repeat(np.arange(len(texts)), blocks)
            starts = begins[owner] + ((np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) << k)
            layout[k] = starts, owner, owner[1:] != owner[:-1], owner[2:] != owner[:-2]
        for h in range(HASHES):
            values = (every ^ _MASKS[h]) * _FACTORS[h]
            for k, (starts, owner, apart1, apart2) in layout.items():
                least = np.minimum.reduceat(values, starts)
                window = least.copy()
                window[:-1] = np.minimum(window[:-1], np.where(apart1, _MAX, least[1:]))
                window[:-2] = np.minimum(window[:-2], np.where(apart2, _MAX, least[2:]))
                where, items = self.classes[k][h].hits(window)
                found.update(zip(owner[where].tolist(), items.tolist(), strict=True))
        return found


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64())])


def _search(texts: DataFrame, index: ItemIndex) -> DataFrame:
    hashes = WordHashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            data, ids = utf8(part), part.column("doc_id")
            out: dict[str, list] = {f.name: [] for f in _FOUND}
            exact: dict[int, set[bytes]] = {}
            for t, i in sorted(index.candidates([shingles(x, hashes) for x in data])):
                if t not in exact:
                    exact = {t: exact_shingles(data[t])}
                shared = len(index.exact[i] & exact[t])
                if 5 * shared >= FIFTHS * len(index.exact[i]):
                    for c, v in zip(out, (ids[t].as_py(), index.ids[i], len(index.exact[i]), shared), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _FOUND], schema=_FOUND)

    return texts.mapInArrow(run, "doc_id bigint, item_id bigint, item_shingles bigint, shared bigint")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment for every document that holds 0.8 or more of an item's shingles."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    query = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null").distinct()
    blocks = -(-query.count() // BLOCK_ITEMS)
    parts = []
    for block in range(blocks):
        own = query.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        parts.append(_search(texts, ItemIndex(sorted(((r[0], r[1].encode()) for r in own), key=lambda x: (x[0] is None, x)))))
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, item_shingles bigint, shared bigint, containment double")
    found = reduce(DataFrame.union, parts).withColumn("containment", F.col("shared") / F.col("item_shingles"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "item_shingles", "shared")).alias("best"))
    return best.select("doc_id", "item_id", "best.item_shingles", "best.shared", "best.containment")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item; rows with a null doc_id go only if such a row was found."""
    return without_ids(docs, contaminated(docs, items))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_sql(table: str, key: str) -> str:
    """DuckDB: distinct (key, s) of a table's shingles."""
    words = f"SELECT {key}, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}"
    places = f"SELECT {key}, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM ({words}) WHERE len(w) > 0"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s FROM ({places})"


ORACLE = f"""
WITH d AS ({shingle_sql('documents', 'doc_id')}), b AS ({shingle_sql('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, any_value(item_shingles) AS item_shingles, count(*) AS shared, count(*) / any_value(item_shingles) AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 5 * count(*) >= {FIFTHS} * any_value(item_shingles)
"""
