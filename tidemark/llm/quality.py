"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata: n_chars, and whether it is missing.

The score is  w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) : the sum-of-squares identity gives
all pairwise interactions in time linear in the features. Word features are presence over the root of their number, so
long texts don't outweigh; statistics are centred and scaled by the training sample.

Trained by AdaGrad on a bounded sample of labelled rows (parameter examples; so many rows at most, also if ids repeat). Every document is scored over its whole
text, however long; rows that repeat an id or a text are scored one by one, equal texts with equal n_chars alike, so ties are harmless. Further columns are not read. A null text counts as empty: it has no words and the statistics of an empty text. A null n_chars, or none at all, counts as 0 and missing. With labels of one class only
the intercept stands for their share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import held_out, map_texts, utf8
from tidemark.llm._features import STRUCTURE, Buckets, chosen_labels, labelled, ragged, row_sums, sigmoid, structure, training_rows, word_buckets

THRESHOLD = 0.7
META = ("meta_chars", "meta_missing")


@dataclass
class FactorisationMachine:
    bits: int
    centre: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray  # words, then statistics
    v: np.ndarray

    def inputs(self, words: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, values and row bounds: each row's words and then its statistics."""
        size, extra = 1 << self.bits, np.arange(stats.shape[1], dtype=np.int32)
        index, bounds = ragged([np.concatenate([x, size + extra]) for x in words])
        scaled = (stats - self.centre) / self.scale
        values = np.concatenate([np.zeros(0), *(np.concatenate([np.full(len(x), 1 / np.sqrt(max(1, len(x)))), s]) for x, s in zip(words, scaled, strict=True))])
        return index, values, bounds

    def logits(self, index: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[index] * values[:, None]
        sums = row_sums(vx, bounds)
        pairs = 0.5 * (sums**2 - row_sums(vx**2, bounds)).sum(1)
        return self.w0 + row_sums(self.w[index] * values, bounds) + pairs, sums

    def scores(self, words: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(*self.inputs(words, stats))[0])


def fit_fm(words: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, bits: int, rank: int = 6, epochs: int = 8, batch: int = 200, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> FactorisationMachine:
    size, rng = (1 << bits) + stats.shape[1], np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    fm = FactorisationMachine(bits, stats.mean(0) if len(stats) else np.zeros(stats.shape[1]), np.maximum(stats.std(0), 1e-3) if len(stats) else np.ones(stats.shape[1]), float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    if len(set(labels.tolist())) < 2:
        fm.v[:] = 0
        return fm
    g0, gw, gv = 1e-3, np.full(size, 1e-3), np.full((size, rank), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(words))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            index, values, bounds = fm.inputs([words[i] for i in rows], stats[rows])
            logit, sums = fm.logits(index, values, bounds)
            slope = (sigmoid(logit) - labels[rows]) / len(rows)
            each = np.repeat(slope, np.diff(bounds)) * values
            touched, local = np.unique(index, return_inverse=True)
            dw = np.bincount(local, each) + decay * fm.w[touched]
            per_row = np.repeat(sums, np.diff(bounds), axis=0) - fm.v[index] * values[:, None]
            dv = np.column_stack([np.bincount(local, each * per_row[:, f]) for f in range(rank)]) + decay * fm.v[touched]
            g0 += slope.sum() ** 2
            gw[touched] += dw**2
            gv[touched] += dv**2
            fm.w0 -= rate * slope.sum() / np.sqrt(g0)
            fm.w[touched] -= rate * dw / np.sqrt(gw[touched])
            fm.v[touched] -= rate * dv / np.sqrt(gv[touched])
    return fm


def with_meta(docs: DataFrame) -> DataFrame:
    """doc_id, text and the columns META; without a column n_chars it is missing in every row."""
    n_chars = (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double")
    return docs.select("doc_id", "text", F.log1p(F.greatest(F.coalesce(n_chars, F.lit(0.0)), F.lit(0.0))).alias(META[0]), n_chars.isNull().cast("double").alias(META[1]))


def train_quality(docs: DataFrame, labels: DataFrame, examples: int = 6000, bits: int = 15, seed: int = 23) -> FactorisationMachine:
    """Learn from at most so many labelled documents, none of them held out."""
    words, stats, y = training_rows(docs, chosen_labels(labelled(labels, "quality"), examples, seed), examples, Buckets(bits), META)
    return fit_fm(words, stats, (y >= 1).astype(float), bits)


def score_quality(docs: DataFrame, model: FactorisationMachine, keep: list[str]) -> DataFrame:
    """keep and score, for every row of docs."""
    buckets = Buckets(model.bits)

    def compute(part: pa.RecordBatch) -> dict:
        data = utf8(part)
        return {c: part.column(c) for c in keep} | {"score": model.scores([word_buckets(x, buckets) for x in data], np.column_stack([np.array([structure(x) for x in data]).reshape(len(data), len(STRUCTURE)), *(part.column(c).to_numpy() for c in META)]))}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_texts(docs, [*keep, *META], compute, f"{schema}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = with_meta(docs)
    model = train_quality(docs, labels)
    return score_quality(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
