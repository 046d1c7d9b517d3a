"""The manifest against one built in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        run = level[i - i % 16 : i - i % 16 + 16]
        out.append((run[: i % 16], run[i % 16 + 1 :]))
        i //= 16
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted((r[0] is not None, r[0] or 0, leaf(r), r) for r in by[s]) for s in order]
    trees = [(t, levels([x[2] for x in t])) for t in trees]
    top = levels([lv[-1][0] for _, lv in trees])
    out = []
    for k, (t, lv) in enumerate(trees):
        for i, (_, _, own, r) in enumerate(t):
            way = siblings(lv, i) + siblings(top, k)
            made = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                made = leaf((*r[:4], None if r[4] is None else r[4].translate({c: c + 32 for c in range(65, 91)})))
            for left, right in way:
                made = h(*left, made, *right)
            out.append((r[0], own, lv[-1][0], top[-1][0], h(*(x for a, b in way for x in a + b)), made, made == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(sources, seed=1):
    r = random.Random(seed)
    text = lambda i: r.choice([None, "", "Abc é 𝒳", f"text {i} É", "lower"])
    rows, i = [], 0
    for s, n in sources.items():
        for _ in range(n):
            rows.append((i, s, r.choice([None, "en"]), r.choice([None, i]), text(i)))
            i += 1
    return r.sample(rows, len(rows))


CASES = {
    "many heights": rows_of({"hot": 700, None: 1, "": 16, "é": 17, "z": 256, "Z": 257, "a": 2, "b": 1}) + [(None, "z", None, None, "X")] * 3 + [(3, "a", "en", 4, "same")] * 40,
    "one source": rows_of({"s": 50}),
    "one row": rows_of({None: 1}),
    "a source for each row": rows_of({f"s{k}": 1 for k in range(300)}),
}


@pytest.mark.parametrize("name", list(CASES))
def test_against_memory(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA + ", leaf string, tree int").repartition(7)
    got = merkle.merkle_digest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def test_places_joined_by_shuffle_and_unsorted_leaves(spark, monkeypatch):
    """Partial parents of any order come together, round by round."""
    monkeypatch.setattr(merkle, "BROADCAST_PLACES", 0)
    rows = CASES["many heights"]
    own, n = merkle.placed(merkle.leaves(spark.createDataFrame(rows, SCHEMA)))
    sorted_nodes, root = merkle.nodes(own, n)
    mixed, again = merkle.nodes(own.repartition(9), n)
    key = lambda df: sorted(map(repr, df.collect()))
    assert root == again == brute(rows)[0][3] and key(sorted_nodes) == key(mixed)


def test_boxes_stay_few():
    """A task over sorted leaves never holds more partial parents than levels."""
    boxes, most, n = merkle.Boxes(1), 0, 5000
    for i in range(n):
        boxes.arrive(0, n, 0, i, f"{i}")
        most = max(most, len(boxes.open))
    assert most <= 4 and not boxes.open and boxes.rows[-1][6] == levels([str(i) for i in range(n)])[-1][0]


def test_empty_and_proofs(spark):
    assert merkle.merkle_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = rows_of({"a": 40, "b": 3})
    m = merkle.manifest(merkle.leaves(spark.createDataFrame(rows, SCHEMA)))
    shown = merkle.proofs(m)
    assert shown.where(merkle.folded(F.col("leaf"), F.col("way")) != m.root).count() == 0
    assert {len(r["way"]) for r in shown.select("way").collect()} == {2, 3}
