"""Toxicity: a linear classifier trained by non-negative positive-unlabelled learning.

Confirmed toxic examples P and unlabelled texts U give the risk  prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)).
Where the second term goes below zero the step climbs it instead of descending, so that a flexible model can't earn a
negative risk by fitting P. Features are the presence of hashed words and of their beginnings, of those that are LIFT times as frequent in P as in U beyond chance; steps are
AdaGrad with an L1 proximal step, which leaves weight only on features that separate P from U.

The training sample is bounded (parameters positives and unlabelled, rows at most), chosen by seeded hash of doc_id. Every document is
scored over its whole text, however long. A null text counts as empty; an empty text scores the intercept. Without a positive example
the prior decides alone. Repeated doc_ids are scored row by row. Equal texts have equal scores, so ties are harmless. Columns
but doc_id and text are never read, whatever their names; reject_toxic passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import held_out, map_texts, smallest_hashes, text_slices, utf8
from tidemark.llm._features import BeginningBuckets, chosen_labels, labelled, ragged, row_sums, sigmoid, training_rows

THRESHOLD = 0.3
#: A feature is learnt from if so many positives have it at least, and it is so many times as frequent in them, by so many standard deviations, so that chance gives few.
LEAST, LIFT, SURE = 3, 2.0, 2.5


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    intercept: float
    weights: np.ndarray

    def buckets(self) -> BeginningBuckets:
        return BeginningBuckets(self.bits)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        values, bounds = ragged(rows)
        return sigmoid(self.intercept + row_sums(self.weights[values], bounds))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int, steps: int = 160, rate: float = 0.3, l1: float = 2e-3) -> ToxicityModel:
    """Full-batch non-negative PU learning with the logistic loss."""
    size = 1 << bits
    weights, intercept = np.zeros(size), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return ToxicityModel(bits, intercept, weights)
    (pv, pb), (uv, ub) = ragged(positive), ragged(unlabelled)
    p_rows, u_rows = np.repeat(np.arange(len(positive)), np.diff(pb)), np.repeat(np.arange(len(unlabelled)), np.diff(ub))
    squares, square0 = np.full(size, 1e-6), 1e-6
    for _ in range(steps):
        p, u = intercept + row_sums(weights[pv], pb), intercept + row_sums(weights[uv], ub)
        negative_risk = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        # Slopes of: prior * mean loss(p, +), and mean loss(u, -) - prior * mean loss(p, -).
        dp_plus, dp_minus, du_minus = prior * (sigmoid(p) - 1) / len(p), -prior * sigmoid(p) / len(p), sigmoid(u) / len(u)
        if negative_risk < 0:
            dp, du = -dp_minus, -du_minus
        else:
            dp, du = dp_plus + dp_minus, du_minus
        slope = np.bincount(pv, dp[p_rows], size)
        slope += np.bincount(uv, du[u_rows], size)
        slope0 = dp.sum() + du.sum()
        squares += slope**2
        square0 += slope0**2
        step = rate / np.sqrt(squares)
        weights -= step * slope
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * l1, 0)
        intercept -= rate / np.sqrt(square0) * slope0
    return ToxicityModel(bits, float(intercept), weights)


def separating(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both without the features that are too rare in positives, or not frequent enough there against unlabelled rows."""
    p, u = (np.bincount(ragged(rows)[0], minlength=size) for rows in (positive, unlabelled))
    expected = (u + 0.5) * (len(positive) / max(1, len(unlabelled)))
    keep = (p >= LEAST) & (p + 0.5 >= LIFT * expected) & (p - expected >= SURE * np.sqrt(expected + 1))
    return [x[keep[x]] for x in positive], [x[keep[x]] for x in unlabelled]


def train_toxicity(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000, bits: int = 20, seed: int = 11) -> ToxicityModel:
    """Learn from at most so many positives and unlabelled texts; held-out rows give neither. The class prior is the share of label 1 among the labels that may be seen."""
    seen = labelled(labels, "toxic")
    n, toxic = seen.agg(F.count("*"), F.sum("label")).first()
    prior = min(0.9, max(0.005, (toxic or 0) / n if n else 0.0))
    buckets = BeginningBuckets(bits)
    p, _, _ = training_rows(docs, chosen_labels(seen.where("label = 1"), positives, seed), positives, buckets)
    u, _, _ = training_rows(docs, smallest_hashes(docs.where(~held_out() & F.col("doc_id").isNotNull()), "doc_id", unlabelled, seed + 1).distinct().withColumn("label", F.lit(0.0)), unlabelled, buckets)
    return fit_nnpu(*separating(p, u, 1 << bits), prior, bits)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """keep and score, for every row of docs."""
    buckets = model.buckets()

    def compute(part: pa.RecordBatch) -> dict:
        return {c: part.column(c) for c in keep} | {"score": model.scores([buckets.of(x) for x in utf8(part)])}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_texts(docs, keep, compute, f"{schema}, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns as they are."""
    model = train_toxicity(docs, labels)
    buckets = model.buckets()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield part.filter(pa.array(model.scores([buckets.of(x) for x in utf8(part)]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train_toxicity(docs, labels)
    return score_toxicity(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
