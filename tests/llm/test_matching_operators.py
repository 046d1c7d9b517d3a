import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontamination, jaccard_join, licenses, mixing, suffix_dedup
from tidemark.llm._common import checkpointed
from tidemark.llm.components import components
from tidemark.llm.decontamination import exact_shingles
from tidemark.llm.shingles import WordHashes, shingle_set, shingle_sets

# ---- n-gram Jaccard join


def classes(rows):
    sets = {d: exact_shingles((t or "").encode()) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for d in sorted(sets):
        for o in {o for g in sets[d] for o in by[g]}:
            common = len(sets[d] & sets[o])
            if 100 * common >= 80 * (len(sets[d]) + len(sets[o]) - common):
                a, b = sorted((find(d), find(o)))
                up[b] = a
        for g in sets[d]:
            by[g].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(n=260, seed=5):
    r = random.Random(seed)
    base = [[f"{r.choice('abcdefgh')}{r.randint(0, 300)}" for _ in range(r.choice([4, 6, 9, 12, 20, 30, 60, 150, 400]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            w[r.randrange(len(w))] = f"n{r.randint(0, 9)}"
        if r.random() < 0.3:
            w[len(w) // 2 : len(w) // 2] = "common line x y z q w e r t".split()
        rows.append((i, " ".join(w)))
    return [*rows, (1000, None), (1001, ""), (1002, "a b"), (1003, "A  B"), (1004, " \t\n")]


def test_classes(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, component long").repartition(5)
    assert {r[0]: tuple(r)[1:] for r in jaccard_join.jaccard_digest(docs).collect()} == classes(rows)


def test_signatures_meet():
    """Any two sets that are similar enough share a signature, whatever is common."""
    r, hashes = random.Random(1), WordHashes()
    near = 0
    for _ in range(400):
        words = [f"w{r.randint(0, 9999)}" for _ in range(r.choice([8, 20, 60, 100, 140, 300, 900]))]
        other = list(words)
        for _ in range(r.randint(0, max(1, len(words) // 30))):
            other[r.randrange(len(other))] = "zz"
        both = [" ".join(x).encode() for x in (words, other)]
        items, bounds = shingle_sets(both, hashes)
        a, b = (items[bounds[i] : bounds[i + 1]] for i in (0, 1))
        assert all((x == shingle_set(t, hashes)).all() for x, t in zip((a, b), both, strict=True))
        common = len(np.intersect1d(a, b))
        if min(len(a), len(b)) >= 4 and 5 * common >= 4 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
            near += 1
            every, _ = jaccard_join.signatures(items, bounds, jaccard_join.Common(np.zeros(0, np.int64)), every=True)
            for part in (every[:0], every[::9], every[::2], every):
                signs, owner = jaccard_join.signatures(items, bounds, jaccard_join.Common(part))
                assert set(signs[owner == 0]) & set(signs[owner == 1])
            sketches = jaccard_join.Sketches(pa.array([jaccard_join.sketch(a), jaccard_join.sketch(b)], pa.list_(pa.int64())))
            one, zero = np.array([1]), np.array([0])
            assert jaccard_join.may_be_similar(sketches, zero, np.array([len(a)]), sketches, one, np.array([len(b)])).all()
    assert near > 150


def test_null_and_repeated_ids(spark):
    """A set that only rows without an id have links others; rows that repeat an id are rows of their own."""
    w = [f"w{i}" for i in range(70)]
    changed = lambda *at: " ".join("new" + x if i in at else x for i, x in enumerate(w))
    rows = [(1, changed(10)), (2, changed(50)), (None, changed()), (3, "other words here only for this one row"), (3, changed(20)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(repr, map(tuple, jaccard_join.jaccard_digest(docs).collect()))) == sorted(map(repr, [(1, 66, 1), (2, 66, 1), (None, 66, 1), (3, 4, 3), (3, 66, 1), (None, 0, None)]))


def star(n):
    """Near copies of one text, most of them not similar to each other."""
    w = [f"w{i}" for i in range(60)]
    return [(i, " ".join(f"n{i}" if k == i % 60 else x for k, x in enumerate(w)) if i else " ".join(w)) for i in range(n)]


def test_links_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    counts, verified, full = [], jaccard_join._verified, jaccard_join._in_full
    monkeypatch.setattr(jaccard_join, "_verified", lambda p, *x: counts.append(p.count()) or verified(p, *x))
    monkeypatch.setattr(jaccard_join, "_in_full", lambda *x: (lambda links: counts.append(links.count()) or links)(checkpointed(full(*x))))
    for n in (600,):
        counts.clear()
        got = jaccard_join.jaccard_digest(spark.createDataFrame(star(n), "doc_id long, text string").repartition(4)).collect()
        assert {r["component_id"] for r in got} == {0} and sum(counts) <= 8 * n, counts


def test_long_texts(spark):
    """Beyond a step of SLICE_BYTES."""
    r = random.Random(3)
    long = [f"w{r.randint(0, 10**9)}" for _ in range(260_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:40_000] + ["x"] + long[40_000:])), (3, " ".join(long[:150_000]))]
    got = {x["doc_id"]: x for x in jaccard_join.jaccard_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 3] and got[1]["n_shingles"] == 259_996


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    up = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert all(got.get(x, x) == c for x, c in up.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_and_empty(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, None, "z"), (4, None, "z")], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()) == [1, 2, 4]
    assert jaccard_join.jaccard_digest(docs.limit(0)).count() == 0


# ---- benchmark decontamination


def test_containment(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randint(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(r.choice([5, 7, 12, 20, 45, 90])))) for i in range(30)] + [(100, None), (101, ""), (102, "x y"), (103, "Repeated item of six words here")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(r.choice([0, 30, 400, 3000]))]
        if r.random() < 0.6:
            passage = r.choice(items[:30])[1].upper().split()
            for _ in range(r.choice([0, 0, 1])):
                passage[r.randrange(len(passage))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = passage
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "X  y"), (203, "repeated ITEM of six words here")]
    want = set()
    for d, t in docs:
        own = exact_shingles((t or "").encode().lower())
        for k, x in items:
            s = exact_shingles((x or "").encode())
            if s and 5 * len(s & own) >= 4 * len(s):
                want.add((d, k, len(s), len(s & own)))
    df, query = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(x)[:4] for x in decontamination.contaminated(df, query).collect()} == want and len(want) > 15
    bad = {w[0] for w in want}
    assert {x["doc_id"] for x in decontamination.clean(df, query).collect()} == {d for d, _ in docs} - bad
    assert decontamination.contaminated(df, query.limit(0)).count() == 0


# ---- suffix-array dedup


def test_repeats(spark):
    r = random.Random(3)
    parts = ["".join(r.choice("abc ") for _ in range(r.randint(50, 300))) for _ in range(6)] + ["a" * 400, "ab" * 200, "é" * 90]
    piece = lambda: (r.choice(parts) if r.random() < 0.7 else "".join(r.choice("xyz") for _ in range(r.randint(0, 120))))[r.randint(0, 20) :]
    rows = [(i, "".join(piece() for _ in range(r.randint(0, 5)))) for i in range(80)] + [(200, None), (201, "")]
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, lo int, copy int").repartition(5)
    got = {x[0]: tuple(x)[1:] for x in suffix_dedup.repeats_digest(docs).collect()}
    assert got == suffix_dedup.brute_force([(d, (t or "").encode()) for d, t in rows])


def test_repeated_rows_and_null_ids(spark):
    r = random.Random(9)
    text = "".join(r.choice("abcdefg") for _ in range(150))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + "!")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffix_dedup.repeats_digest(docs).collect()) == [(-1, 150), (1, 0), (1, 150), (2, 150)]
    assert suffix_dedup.repeats_digest(docs.limit(0)).count() == 0


# ---- source mixing


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["b", "a", None, "c"]), " ".join("w" for _ in range(r.randint(0, 60)))) for i in range(600)] + [(900, "d", None), (901, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    # Targets by the reshare as stated.
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s for s in order if s not in capped}
        level = (total - sum(capped.values())) / sum(weight[s] for s in rest)
        over = {s: 2.0 * sizes[s] for s in rest if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: capped.get(s, weight[s] * level) for s in order}
    assert len(got) == len(rows)
    for s in order:
        own = [x for x in got if x["source"] == s]
        assert all(abs(x["target"] - want[s]) < 1e-6 and x["source_size"] == sizes[s] and x["taken"] <= 2 * x["size"] for x in own)
        assert abs(sum(x["taken"] for x in own) - want[s]) <= 70
        assert all(len(x["placements"]) * x["size"] == x["taken"] for x in own)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix_digest(docs.limit(0)).count() == 0


def test_digest_has_the_draws(spark):
    docs = spark.createDataFrame([(i, "one two three four", "ab"[i % 7 == 0]) for i in range(300)], "doc_id long, text string, source string")
    placed = {r["doc_id"]: [p["shard"] for p in r["placements"]] for r in mixing.mix(docs).collect()}
    got = mixing.mix_digest(docs).collect()
    assert {r["doc_id"]: r["shards"] for r in got} == placed and all(r["taken"] == r["size"] * len(r["shards"]) for r in got)
    assert sum(map(len, placed.values())) and {s for x in placed.values() for s in x} <= set(range(mixing.SHARDS))


def test_hypergeometric(spark):
    made = spark.range(4000).selectExpr(mixing.hypergeometric_sql("50L", "20L", "10L", "(cast(id as double) + 0.5) / 4000") + " as x").collect()
    counts = Counter(r["x"] for r in made)
    assert abs(sum(k * n for k, n in counts.items()) / 4000 - 4) < 0.01
    from math import comb

    for k in range(11):
        assert abs(counts[k] / 4000 - comb(20, k) * comb(30, 10 - k) / comb(50, 10)) < 0.001


# ---- licences


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\nmore"), (2, "a/b/x", "text"), (3, "a/b/c/y", "x\nLicensed under the Apache License, Version 2.0.\nz"), (4, "d/z", "licensed to nobody in particular"), (5, "a/w", None),
        (6, None, "plain"), (7, "a/b/v", ""), (8, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r["doc_id"]: (r["own_licence"], r["licence"], r["licence_dir"]) for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "GPL-3.0", "a/b"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, None, None), 5: (None, "MIT", "a"), 6: (None, None, None), 7: (None, "GPL-3.0", "a/b"), 8: ("GPL-3.0", "GPL-3.0", None),
    }


def test_notices_among_other_words(spark):
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."
    texts = {
        "Copyright (c) 2020 Foo Inc. Released under the MIT License.": "MIT", "Copyright 2019 Acme Corp. Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Some prose before it. Released under the MIT License.": "MIT",
        "Mozilla Public License Version 2.0": "MPL-2.0", gpl: "GPL-3.0", "word " * 3000 + "under the ISC License " + "word " * 3000: "ISC", "Copyright (c) 2021 A\n\n" + licenses._MIT: "MIT", "Copyright B 2022\n" + licenses._ISC: "ISC",
        "ISC License\n\nCopyright B 2022\n": "ISC", "It was released under the license of its owner.": None, "My driving license expired, by the way.": None, "All copyright laws hold for the general public.": None, None: None,
    }
    rows = [(k, f"d{k}/x", x) for k, x in enumerate(texts)]
    got = {r["doc_id"]: r["own_licence"] for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == dict(enumerate(texts.values()))


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefg" for b in range(90)]
    item = " ".join(r.choice(words) for _ in range(30))
    rows, labels = [], []
    for i in range(120):
        w = [r.choice(words) for _ in range(r.randint(20, 60))]
        toxic = i % 5 == 0
        rows.append((i, " ".join(["scum"] * toxic + w), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(200, rows[1][1], "en", "s0", 1), (201, item + " tail", "en", "s1", 1), (202, "words around token=abcdefgh99 here", "en", "s1", 1), (203, None, None, None, None)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {x["doc_id"]: x for x in pipeline.run(spark, str(tmp_path)).collect()}
    want = {i for i in range(120) if i % 5} | {202, 203}
    assert set(got) == want and got[202]["size"] == 4


def test_pipeline_at_the_edges(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties and other columns, then no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    words = [f"{a}{b}" for a in "abcdefg" for b in range(90)]
    toxic = lambda i: i % 5 == 0
    rows = [(i, " ".join(["scum"] * toxic(i) + [r.choice(words) for _ in range(30)]), "en", f"s{i % 2}", 1) for i in range(100)]
    long = " ".join(r.choice(words) for _ in range(60_000))
    rows += [(140, None, None, None, None), (141, "", "en", "s0", 0), (142, long, "en", "s0", 9), (None, "words of a row without an id", None, "s1", 2), (150, rows[3][1], "en", "s1", 3), (3, *rows[3][1:]), (160, "one tie of five words", "en", "s0", 1), (161, "one tie of five words", "en", "s0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data, given in (("labels", [(i, 1, int(toxic(i))) for i in range(100)], "doc_id long, quality int, toxic int"), ("benchmark", [(1, "an item of more than five words")], "item_id long, text string")):
        for at in ("full", "none"):
            spark.createDataFrame(data, given).write.parquet(str(tmp_path / at / f"{name}.parquet"))
    extra = spark.createDataFrame([(*x, 1, "c", 0.5) for x in rows], schema + ", node int, comp string, score double")
    extra.write.parquet(str(tmp_path / "full" / "documents.parquet"))
    extra.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    stage = dict(pipeline.STAGES)["ngram_jaccard_join"]
    kept = stage(spark, docs, str(tmp_path / "full"))
    assert kept.columns == docs.columns
    ids = sorted(x["doc_id"] if x["doc_id"] is not None else -1 for x in kept.select("doc_id").collect())
    assert ids == sorted([*range(100), 140, 141, 142, -1, 160])
    got = [x["doc_id"] for x in pipeline.run(spark, str(tmp_path / "full")).collect()]
    assert len(got) == len(set(got)) and set(got) == {i for i in range(100) if not toxic(i)} | {140, 141, 142, None, 160}
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_licences_of_repeated_rows(spark):
    """Rows that repeat an id and a path have answers of their own."""
    rows = [(1, "a/x", "Released under the MIT License."), (1, "a/x", "Licensed under CC BY 4.0."), (1, "a/x", "Released under the MIT License."), (None, "a/x", None), (1, None, "plain")]
    files = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, path string, text string, score double, term int")
    got = licenses.scan_licences(files)
    assert sorted(str(r["own_licence"]) for r in got.collect()) == ["CC-BY-4.0", "MIT", "MIT", "None", "None"]
    assert licenses.scan_licences(files.limit(0)).count() == 0
