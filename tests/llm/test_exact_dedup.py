"""Block naming against grouping by the whole normalised text."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, t))
    out = []
    for text, own in groups.items():
        best = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        sha, kept = hashlib.sha256(text.encode()).hexdigest(), False
        for d, t in own:
            stays = not kept and d == best[0] and len(t or "") == len(best[1] or "")
            kept |= stays
            out.append((d, best[0], len(own), stays, sha))
    return out


def rows_of(seed=1):
    r = random.Random(seed)
    base = ["".join(r.choice("ab é\n\t𝒳") for _ in range(r.choice([0, 1, 3, 7, 8, 9, 15, 16, 17, 40, 300]))) for _ in range(40)]
    base += [base[-1] + "a", "a" + base[-1], base[-1][:-1], "x" * 64, "x" * 65, "x" * 128]
    rows = [(i, r.choice(base)) for i in range(400)]
    spaced = [(500 + i, " ".join(t)) for i, (_, t) in enumerate(rows[:50])]
    return [*rows, *spaced, (1000, None), (1001, ""), (1002, " \t\n\x0b\x0c\r"), (1003, " "), (None, base[3]), (None, None), (7, rows[7][1]), (7, rows[7][1]), (7, "other")]


@pytest.mark.parametrize("collide", [False, True])
def test_against_brute_force(spark, collide):
    """With a hash that most blocks share, names come from bytes; with few bytes a block, from many levels."""
    rows = rows_of()
    docs = spark.createDataFrame([(*x, 1, "n") for x in rows], "doc_id long, text string, name int, level string").repartition(5)
    few = (lambda b: F.xxhash64(b) % 3) if collide else exact_dedup._hash
    got = exact_dedup.classes(exact_dedup._rows(docs), 8, few).select("doc_id", "keep_id", "group_size", F.expr("row = keep_row"), "text_sha256").collect()
    key = lambda x: repr(x)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_long_texts_and_one_of_each(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, long), (2, long.replace(" ", "\n  ")), (3, long + "x"), (4, "y" + long), (5, "tie"), (6, "tie"), (6, "tie")]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, _row int").select("doc_id", "text", F.col("_row").alias("row"))
    got = {(x["doc_id"], x["keep_id"], x["group_size"]) for x in exact_dedup.exact_digest(docs).collect()}
    assert got == {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1), (5, 5, 3), (6, 5, 3)}
    kept = exact_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(x["row"] for x in kept.collect()) == [1, 2, 3, 4]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_digest(none).count() == 0 and exact_dedup.one_of_each(none).count() == 0
