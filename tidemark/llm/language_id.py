"""Language identification with a blended-spectrum string kernel.

Two texts' kernel is the mean over n = 1..4 of |A_n and B_n| / sqrt(|A_n| |B_n|), A_n and B_n being the sets of hashed byte
n-grams present in the lower-cased texts. Landmark texts give a Nystroem map  phi(x) = k(x, L) (K_LL + ridge)^(-1/2) ; one-versus-rest
kernel ridge regression in that space gives one score a language. Scoring is two matrix products for a batch of texts:
presence by landmarks, then kernel values by language.

Landmarks and training texts are bounded samples by seeded hash of doc_id (parameters landmarks, examples; both shared
out evenly over languages; 2 * examples rows at most, also where ids repeat). Their n-gram sets are made where the texts are and only sets reach the driver, at most 2^20 numbers a row
however long its text. Whole texts are read, however long, in pieces; rows that repeat an id or a text are answered one by one, equal texts alike. A null text or one without a letter gets `und` and score 0; so does every text when nothing can be
learnt. Scores that agree to five places tie, and ties go to the language that sorts first. An empty table gives no rows. Other columns of docs, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import held_out, map_texts, utf8

ORDERS = (1, 2, 3, 4)
BITS = 18
#: Bytes that are looked at together; a longer text is looked at in pieces that overlap by one n-gram.
PIECE = 1 << 20


def grams(data: bytes, scratch: np.ndarray | None = None) -> list[np.ndarray]:
    """For each order, the sorted distinct hash buckets of the lower-cased text's n-grams."""
    out: list[list[np.ndarray]] = [[] for _ in ORDERS]
    low = data.decode("utf-8", "replace").lower().encode()
    for at in range(0, max(1, len(low)), PIECE):
        codes = np.frombuffer(low[at : at + PIECE + ORDERS[-1] - 1], np.uint8).astype(np.uint32)
        packed = codes
        for k, n in enumerate(ORDERS):
            if n > 1:
                packed = (packed[:-1] << np.uint32(8)) | codes[n - 1 :] if len(codes) >= n else packed[:0]
            hashed = (packed * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            seen = np.zeros(1 << BITS, bool) if scratch is None else scratch
            seen[hashed] = True
            if len(hashed) < 4096:
                found = np.unique(hashed)
            else:
                found = np.flatnonzero(seen)
            seen[found] = False
            out[k].append(found.astype(np.int32))
    return [reduce(np.union1d, pieces) if len(pieces) > 1 else pieces[0] for pieces in out]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    column: np.ndarray  # order by bucket: column of the landmark matrix, or -1
    landmarks: np.ndarray  # n-grams by landmarks, each column scaled by its own norm
    weights: np.ndarray  # landmarks by languages

    def kernel(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        present = np.zeros((len(texts), self.landmarks.shape[0]), np.float32)
        for row, orders in zip(present, texts, strict=True):
            for k, found in enumerate(orders):
                if len(found):
                    at = self.column[k, found]
                    row[at[at >= 0]] = 1 / np.sqrt(len(found)) / len(ORDERS)
        return present @ self.landmarks

    def scores(self, texts: list[list[np.ndarray]]) -> np.ndarray:
        return self.kernel(texts) @ self.weights


def fit_language(features: list[list[np.ndarray]], langs: list[str], landmarks: int, ridge: float = 1e-3) -> LanguageModel:
    """features: of each text, what grams gives of it."""
    languages = sorted(set(langs))
    picked: list[int] = []
    by_lang = {x: [i for i, y in enumerate(langs) if y == x] for x in languages}
    for x in languages:
        picked += by_lang[x][: max(1, landmarks // max(1, len(languages)))]
    column, n = np.full((len(ORDERS), 1 << BITS), -1, np.int32), 0
    for k in range(len(ORDERS)):
        if found := [features[i][k] for i in picked]:
            buckets = np.unique(np.concatenate(found))
            column[k, buckets] = np.arange(n, n + len(buckets))
            n += len(buckets)
    matrix = np.zeros((n, len(picked)), np.float32)
    for j, i in enumerate(picked):
        for k, found in enumerate(features[i]):
            if len(found):
                matrix[column[k, found], j] = 1 / np.sqrt(len(found))
    model = LanguageModel(languages, column, matrix, np.zeros((len(picked), len(languages)), np.float32))
    if not languages:
        return model
    k_ll = model.kernel([features[i] for i in picked]).astype(float)
    values, vectors = np.linalg.eigh((k_ll + k_ll.T) / 2 + ridge * np.eye(len(picked)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-9))
    k_nl = np.concatenate([model.kernel(features[at : at + 64]) for at in range(0, len(features), 64)]).astype(float)
    phi, y = k_nl @ whiten, np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    balance = (1 / np.array([len(by_lang[x]) for x in langs]))[:, None]
    beta = np.linalg.solve(phi.T @ (phi * balance) + ridge * np.eye(phi.shape[1]), phi.T @ (y * balance))
    return LanguageModel(languages, column, matrix, (whiten @ beta).astype(np.float32))


def train_language(docs: DataFrame, landmarks: int = 64, examples: int = 1200, seed: int = 31) -> LanguageModel:
    """Learn from text and lang of documents that aren't held out. Each language gives up to its share of examples: first its rows are counted, then rows under a hash threshold are taken, so no row is shuffled."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit_language([], [], landmarks)
    each = max(1, examples // len(counts))
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    rate = reduce(lambda c, x: c.when(F.col("lang") == x[0], int(min(1.0, each / x[1]) * (1 << 30)) + 1), sorted(counts.items()), F)
    # About examples rows are below the threshold, unless ids repeat: then those with the least share of it stand for all.
    below = known.where((spread < rate) & F.col("text").isNotNull()).select((spread / rate).alias("at"), "doc_id", "lang", F.xxhash64("text").alias("named"), "text")
    kept, sets = ["at", "doc_id", "lang", "named"], [f"grams{n}" for n in ORDERS]

    def compute(part: pa.RecordBatch) -> dict:
        scratch = np.zeros(1 << BITS, bool)
        made = [grams(x, scratch) for x in utf8(part)]
        return {c: part.column(c) for c in kept} | {c: [m[k] for m in made] for k, c in enumerate(sets)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in below.select(*kept).schema)
    made = map_texts(below, kept, compute, f"{schema}, {', '.join(f'{c} array<int>' for c in sets)}")
    rows = made.orderBy("at", "doc_id", "named").limit(2 * examples).toArrow().sort_by([(c, "ascending") for c in ("at", "doc_id", "named")])
    of, features, langs = np.array(rows.column("lang").to_pylist(), object), [], []
    for x in sorted(counts):
        own = rows.take(np.flatnonzero(of == x)[:each])
        features += [[v.values.to_numpy() for v in row] for row in zip(*(own.column(c) for c in sets), strict=True)]
        langs += [x] * len(own)
    return fit_language(features, langs, landmarks)


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """keep, lang_pred and score, the winner's share in a softmax of four times the languages' scores, for every row of docs."""

    def compute(part: pa.RecordBatch) -> dict:
        texts, data = part.column("text").to_pylist(), utf8(part)
        can = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
        lang, score, scratch = ["und"] * len(texts), [0.0] * len(texts), np.zeros(1 << BITS, bool)
        for at in range(0, len(can), 64):
            rows = can[at : at + 64]
            found = model.scores([grams(data[i], scratch) for i in rows]).round(5)
            best = found.argmax(1)
            share = np.exp(4 * (found - found.max(1, keepdims=True)))
            for i, b, s in zip(rows, best, 1 / share.sum(1), strict=True):
                lang[i], score[i] = model.languages[b], float(s)
        return {c: part.column(c) for c in keep} | {"lang_pred": lang, "score": score}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_texts(docs, keep, compute, f"{schema}, lang_pred string, score double")


def language_ids(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = train_language(docs)
    return predict_language(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
