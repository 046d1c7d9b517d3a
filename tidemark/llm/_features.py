"""Hashed words and structure statistics of texts, for the trained scorers."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import held_out, map_texts, smallest_hashes, utf8

#: ASCII bytes that aren't letters or digits part words; bytes beyond ASCII are kept as they are.
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Buckets(dict):
    """Word to hash bucket; forgets all when it holds most words, so memory stays bounded."""

    def __init__(self, bits: int, most: int = 500_000):
        self.bits, self.mask, self.most = bits, (1 << bits) - 1, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        self[word] = bucket = self.bucket(word)
        return bucket

    def bucket(self, word: bytes):
        return zlib.crc32(word) & self.mask

    def of(self, data: bytes) -> np.ndarray:
        """Sorted distinct buckets of the text's lower-cased words."""
        return np.array(sorted(set(map(self.__getitem__, data.lower().translate(_SPLIT).split()))), np.int32)


class BeginningBuckets(Buckets):
    """Word to the buckets of the word and of its beginnings of LENGTHS bytes, so that forms of one stem have a bucket in common."""

    LENGTHS = range(4, 8)

    def __init__(self, bits: int, most: int = 120_000):  # an entry takes about 300 bytes
        super().__init__(bits, most)

    def bucket(self, word: bytes):
        return tuple({zlib.crc32(x) & self.mask for x in (word, *(b" " + word[:k] for k in self.LENGTHS if k < len(word)))})

    def of(self, data: bytes) -> np.ndarray:
        return np.array(sorted(set(chain.from_iterable(map(self.__getitem__, set(data.lower().translate(_SPLIT).split()))))), np.int32)


def word_buckets(data: bytes, buckets: Buckets) -> np.ndarray:
    return buckets.of(data)


#: The structure statistics, in order.
STRUCTURE = ("log_words", "mean_word", "distinct_words", "upper", "punctuation", "digits", "runs", "line_words", "distinct_lines", "long_words", "no_words")


def structure(data: bytes) -> list[float]:
    """Statistics of the whole text between about -1 and 1; an empty text has only no_words set."""
    words = data.split()
    if not words:
        return [0.0] * (len(STRUCTURE) - 1) + [1.0]
    n, codes = len(words), np.frombuffer(data, np.uint8)
    kinds = np.bincount(codes, minlength=256)
    solid = max(1, len(codes) - int(kinds[:33].sum()))
    letters = max(1, int(kinds[65:91].sum() + kinds[97:123].sum() + kinds[128:].sum()))
    punctuation = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(n) / 10, min(solid / n, 20) / 10, len(set(words)) / n, kinds[65:91].sum() / letters, punctuation / solid, kinds[48:58].sum() / solid,
        same / n, np.log1p(n / max(1, len(lines))) / 5, len(set(lines)) / max(1, len(lines)), sum(len(w) > 20 for w in words) / n, 0.0,
    ]


def ragged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values end to end, and where each row begins (one more than rows)."""
    return np.concatenate([np.zeros(0, np.int32), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum over each row, empty rows 0; each row's sum depends on that row alone."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def featurised(docs: DataFrame, keep: list[str], buckets: Buckets) -> DataFrame:
    """keep, words: buckets of the whole text, and stats: its structure statistics."""

    def compute(part: pa.RecordBatch) -> dict:
        data = utf8(part)
        return {c: part.column(c) for c in keep} | {"words": [buckets.of(x) for x in data], "stats": [structure(x) for x in data]}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_texts(docs, keep, compute, f"{schema}, words array<int>, stats array<double>")


def training_rows(docs: DataFrame, chosen: DataFrame, most: int, buckets: Buckets, meta: tuple[str, ...] = ()) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features of the documents in chosen (doc_id, label), of most rows if ids repeat: words, statistics with the columns meta behind them, labels, by doc_id."""
    kept = docs.select("doc_id", "text", *meta).join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")
    bounded = featurised(kept, ["doc_id", "label", *meta], buckets).orderBy(F.xxhash64("doc_id", "words"), "doc_id").limit(most)
    got = bounded.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks()
    column = got.column("words").combine_chunks()
    # Copies, so that what Arrow holds can go at once: the driver's memory is for more than training.
    values, bounds = column.flatten().to_numpy().copy(), column.offsets.to_numpy() - (column.offsets[0].as_py() if len(column) else 0)
    words = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    stats = got.column("stats").combine_chunks().flatten().to_numpy().reshape(len(words), len(STRUCTURE)).copy()
    stats = np.column_stack([stats, *(got.column(c).to_numpy() for c in meta)])
    labels = got.column("label").to_numpy().copy()
    del got, column
    pa.default_memory_pool().release_unused()
    return words, stats, labels


def labelled(labels: DataFrame, label: str | Column) -> DataFrame:
    """doc_id and label of the rows that may be learnt from: not held out, neither null."""
    return labels.where(~held_out()).select("doc_id", (F.col(label) if isinstance(label, str) else label).cast("double").alias("label")).dropna()


def chosen_labels(rows: DataFrame, n: int, seed: int) -> DataFrame:
    return smallest_hashes(rows, "doc_id", n, seed, "label").select("doc_id", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
