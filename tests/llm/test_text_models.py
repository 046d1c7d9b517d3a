import os
import random

import numpy as np
import pytest

from tidemark.llm import language_id, quality, toxicity
from tidemark.llm._features import STRUCTURE, Buckets, structure, training_rows, word_buckets

SCHEMA = "doc_id long, text string, lang string, source string, score double"


def corpus(n=400, seed=0):
    r = random.Random(seed)
    words = {"aa": ["the", "of", "and", "house", "river"], "bb": ["für", "über", "schon", "würde", "straße"]}
    rows, labels = [], []
    for i in range(n):
        lang = r.choice(["aa", "bb"])
        text = [r.choice(words[lang]) + str(r.randint(0, 9)) for _ in range(r.randint(5, 60))]
        toxic, good = r.random() < 0.2, r.random() < 0.7
        if toxic:
            text.insert(r.randrange(len(text)), "Scum,")
        text = " ".join(text) if good else " ".join(w.upper() + "!!" for w in text)
        rows.append((i, text, lang, None, 0.5))
        if r.random() < 0.8:
            labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, "aa", "s", 1.0), (1001, "", None, "s", 1.0), (1002, "12 34", "aa", "s", 1.0), (1003, rows[0][1], "aa", "s", 1.0), (1003, rows[0][1], "aa", "s", 1.0), (None, "the", None, None, None)]
    labels += [(1000, None, None), (None, 1, 1)]
    return rows, labels


def test_three_models(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    toxic = toxicity.toxicity_scores(docs, marks).collect()
    good = quality.quality_scores(docs, marks).collect()
    for got, k in ((good, 0), (toxic, 1)):
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        held = [r for r in got if r["held_out"] and r["doc_id"] in truth and truth[r["doc_id"]][k] is not None]
        assert len(held) > 30 and np.mean([r["predicted"] == truth[r["doc_id"]][k] for r in held]) > 0.95
    langs = language_id.language_ids(docs).collect()
    known = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 1000}
    assert all(r["lang_pred"] == known[r["doc_id"]] for r in langs if r["doc_id"] in known)
    assert {r["doc_id"]: r["lang_pred"] for r in langs if r["doc_id"] in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    kept = {r["doc_id"] for r in toxicity.reject_toxic(docs, marks).collect()}
    assert np.mean([(i in kept) == (not t) for i, (_, t) in truth.items() if i is not None and t is not None]) > 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_predicted_on_held_out_rows(spark):
    """By predicted, at its threshold, not by the order of scores."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in marks.collect()}
    got = [(r["predicted"], truth[r["doc_id"]]) for r in toxicity.toxicity_scores(docs, marks).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert sum(t for _, t in got) > 100
    assert np.mean([p for p, t in got if t]) >= 0.9 and np.mean([1 - p for p, t in got if not t]) >= 0.9


def test_unseen_forms_of_a_stem(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"word{r.randint(0, 400)}" for _ in range(20)) + (f" lostra{r.randint(0, 10**9)}" if i % 4 == 0 else "")) for i in range(400)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.toxicity_scores(docs, marks).collect() if r["held_out"]]
    assert len(got) > 60 and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got)


def test_samples_are_bounded(spark):
    """An id that repeats brings no more rows than the sample may have; its rows are all scored."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(3, "scum")], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 1.0), (3, 0.0)], "doc_id long, label double")
    words, stats, y = training_rows(docs, chosen, 50, Buckets(10))
    assert len(words) == len(stats) == len(y) == 50
    marks = spark.createDataFrame([(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, marks).count() == quality.quality_scores(docs, marks).count() == 301


def test_long_texts_and_clashing_columns(spark):
    long = "filler " * 400_000
    rows = [(i, ("scum " if i % 3 == 0 else "kind ") + (long if i > 396 else f"x{i % 7} y{i % 5}"), 0.5, 1, "w") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label int, words string")
    marks = spark.createDataFrame([(i, 1 - int(i % 3 == 0), int(i % 3 == 0)) for i in range(397)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, marks).collect()}
    assert {i: got[i] for i in (397, 398, 399)} == {397: 0, 398: 0, 399: 1}
    assert toxicity.reject_toxic(docs, marks).columns == docs.columns
    assert quality.quality_scores(docs, marks).count() == 400 and quality.quality_scores(docs.limit(0), marks).count() == toxicity.toxicity_scores(docs.limit(0), marks).count() == 0


def test_metadata_counts(spark):
    """One text throughout, so that only n_chars tells good from bad; a null one is scored, too."""
    rows = [(i, "the same words", 10 if i % 2 else 100000) for i in range(400)] + [(400, "the same words", None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, marks).collect()}
    assert len(got) == 401 and 0 <= got[400]["score"] <= 1
    assert all(got[i]["predicted"] == i % 2 for i in range(400))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, 0.0), (2, None, None, None, 0.0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity_scores(docs, none).collect()] == [0, 0]
    assert quality.quality_scores(docs, none).count() == 2
    assert {r["lang_pred"] for r in language_id.language_ids(docs).collect()} == {"und"}
    assert language_id.language_ids(docs.limit(0)).count() == 0


def test_features():
    b = Buckets(10)
    assert word_buckets(b"A a, a! B", b).tolist() == sorted({b[b"a"], b[b"b"]})
    assert len(structure(b"")) == len(structure(b"x y\nz")) == len(STRUCTURE)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    words, stats = [np.array([1, 5, 9], np.int32), np.zeros(0, np.int32)], rng.normal(size=(2, len(STRUCTURE)))
    fm = quality.FactorisationMachine(4, np.zeros(len(STRUCTURE)), np.ones(len(STRUCTURE)), 0.3, rng.normal(size=16 + len(STRUCTURE)), rng.normal(size=(16 + len(STRUCTURE), 3)))
    index, values, bounds = fm.inputs(words, stats)
    for row, got in enumerate(fm.logits(index, values, bounds)[0]):
        i, x = index[bounds[row] : bounds[row + 1]], values[bounds[row] : bounds[row + 1]]
        pairs = sum(fm.v[i[a]] @ fm.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(got, 0.3 + fm.w[i] @ x + pairs)


def test_string_kernel():
    texts = [language_id.grams(t) for t in (b"abcab", b"xyz", b"")]
    m = language_id.fit_language([language_id.grams(t) for t in (b"abcab", b"abd", b"xyz", b"xyy")], ["a", "a", "x", "x"], 4)
    k = m.kernel(texts)
    assert np.isclose(k[0, 0], 1) and k[1, 0] == 0 and (k[2] == 0).all() and m.scores(texts)[:2].argmax(1).tolist() == [0, 1]


def test_risk_stays_above_zero():
    p = [np.array([1, 2], np.int32)] * 20
    u = [np.array([1, 2], np.int32)] * 5 + [np.array([3, 4], np.int32)] * 95
    m = toxicity.fit_nnpu(p, u, 0.05, 3)
    assert m.scores([p[0]])[0] > 0.3 > m.scores([u[-1]])[0]


def test_language_learns_from_sets_as_from_texts(spark):
    """The sets that tasks make are those of the texts, also of repeated ids and of a text of many pieces, and the model is the one learnt from texts."""
    rows = [(i, f"{'river house' if i % 2 else 'straße für'} {i}", "ab"[i % 2], None, None) for i in range(60)] + [(7, "river river", "b", None, None)] * 3 + [(8, None, "a", None, None)]
    rows.append((12, "straße über " * 150_000, "a", None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train_language(docs, examples=10_000)
    learnt = {tuple(r) for r in docs.where(language_id.held_out()).select("doc_id").collect()}
    own = [r for r in rows if r[1] is not None and (r[0],) not in learnt]
    again = language_id.fit_language([language_id.grams(r[1].encode()) for r in own], [r[2] for r in own], 10_000)
    probe = [language_id.grams(t) for t in (b"river", "straße".encode(), b"house 12", b"")]
    assert model.languages == again.languages == ["a", "b"]
    assert np.allclose(model.scores(probe), again.scores(probe), atol=1e-3) and model.scores(probe)[:2].argmax(1).tolist() == [1, 0]


def test_language_of_long_texts_and_ties(spark, monkeypatch):
    text = ("abc déf " * 40 + "Z").encode()
    whole = language_id.grams(text)
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, language_id.grams(text), strict=True))
    monkeypatch.undo()
    docs = spark.createDataFrame([(i, "same words", lang, None, None) for i in range(40) for lang in ("q", "p")], SCHEMA)
    assert {r["lang_pred"] for r in language_id.language_ids(docs).collect()} == {"p"}
