"""Phrases against counting all of them."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as co


def brute(rows, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        c = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {(p[b : b + s], a) for p, a in c.items() for s in range(2, len(p)) for b in range(len(p) - s + 1)}
        found = []
        for p, a in c.items():
            if (p, a) not in inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(n=300, seed=4):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "été", "ABC", "a\x1cb", "x\x00y", "-"]
    weights = [1 / (i + 1) for i in range(len(words))]
    phrases = [r.choices(words, k=r.randint(2, 7)) for _ in range(12)]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(r.randint(0, 40)):
            part = r.choice(phrases) if r.random() < 0.4 else r.choices(words, weights, k=r.randint(1, 6))
            text += r.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "!", "?:", "\x0b"]) + " ".join(part)
        rows.append((text, r.choice(["en", "en", "en", "de", None])))
    return [*rows, (None, "en"), ("", None), ("w0 " * 500, "en"), ("w0 w1 w0 w1", "fr"), *[("one text of copies here and there", "xx")] * 60, ("und", "und")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, 1, 2) for x in corpus()], "text string, lang string, w1 int, f int").repartition(6)


@pytest.mark.parametrize("hot_share", [1, 60, 10_000_000])
def test_against_brute_force(docs, hot_share):
    """Without hot prefixes, with some, and with all of them dealt by their next words."""
    got = co.collocations(docs, 8, 50, hot_share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(corpus(), 8, 50)


def test_steps_and_small_bit_maps(spark, docs, monkeypatch):
    """Texts beyond a step are read in steps that overlap, and a bit map that lets all through changes nothing."""
    whole = {tuple(r) for r in co.frequent_phrases(docs, 8)[0].collect()}
    docs = docs.select("text", "lang")
    monkeypatch.setattr(co, "bit_map", lambda keys: co.Bits(1 << 15, [(0, b"\xff" * 4096)]))
    assert {tuple(r) for r in co.frequent_phrases(docs, 8)[0].collect()} == whole
    text = " ".join(f"{w}." if i % 7 == 3 else w for i, w in enumerate(random.Random(3).choices(["a", "b", "c", "dd"], k=4000)))
    table = next(iter(spark.createDataFrame([(text, "x")], "text string, lang string").toArrow().to_batches()))
    for size in (10, 100, 10_000):
        found = Counter()
        for _, h, own in co.hash_steps(iter([table]), size, co.Hashes(0)):
            found.update(tuple(h[i : i + 5].tolist()) for i in range(own))
        h = co.Hashes(0).of(co.words_of(text.encode()))
        assert found == Counter(tuple(h[i : i + 5].tolist()) for i in range(len(h)))


def test_seed_changes_when_words_collide(docs, monkeypatch):
    """Two frequent words under one hash are seen, and counted again under another seed."""
    plain = co.Hashes.hashed
    monkeypatch.setattr(co.Hashes, "hashed", lambda self, word: plain(self, word) % 5 + 1 if self.seed == 0 else plain(self, word))
    phrases, words, _ = co.frequent_phrases(docs, 8)
    spelt = {(r["lang"], r["h"]): bytes(r["word"]) for r in words.collect()}
    assert len(set(spelt.values())) > 5
    ones = {(r["lang"], spelt[r["lang"], r["w1"]]): r["f"] for r in phrases.where("w2 = 0").collect()}
    want = Counter((lang or "und", w) for t, lang in corpus() for w in co.words_of((t or "").encode()) if w != b".")
    assert ones == {k: v for k, v in want.items() if v >= 8}


def test_products_beyond_64_bits(spark):
    none = [0, 0, 0]
    a, left, right, n = 10**11, 3 * 10**11, 5 * 10**11 + 7, 9 * 10**12
    phrases = spark.createDataFrame([("e", 1, 0, *none, left), ("e", 2, 0, *none, right), ("e", 1, 2, *none, a)], "lang string, w1 long, w2 long, w3 long, w4 long, w5 long, f long")
    row = co.scored(phrases, spark.createDataFrame([("e", n)], "lang string, n long")).first()
    assert row["score"] == 1000 * a * n // (left * right) and (row["l"], row["r"]) == (left, right)


def test_empty(spark):
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None), ("", "e")], "text string, lang string")).count() == 0


def test_growth_holds_little():
    """Prefixes that reach over batches are counted once, and only the last of each length waits."""
    words = np.array(sorted((1, 2, r.randint(1, 3), r.randint(1, 3), r.randint(1, 3)) for r in [random.Random(9)] for _ in range(500)), np.int64)
    growth, found = co.Growth(1), Counter()
    for i in range(0, 500, 7):
        part = words[i : i + 7]
        batches = list(growth.add(np.array(["e"] * len(part), object), part, np.full(len(part), 2), np.ones(len(part), np.int64)))
        assert all(len(x[0]) == 1 for x in growth.waiting.values())
        for b in batches:
            found.update({tuple(r[w] for w in co.WORDS): r["c"] for r in b.to_pylist()})
    for b in growth.ended():
        found.update({tuple(r[w] for w in co.WORDS): r["c"] for r in b.to_pylist()})
    want = Counter(tuple([*w[:k].tolist(), *[0] * (5 - k)]) for w in words for k in (3, 4, 5))
    assert found == want
