from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dipfold.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        t = {s: repeats * sizes[s] if s in full else rest * w[s] / share for s in names}
        over = {s for s in names if s not in full and t[s] > repeats * sizes[s]}
        if not over:
            return t
        full |= over


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["b", "a", None, "", "é", "zz", "tiny"]
    rows = []
    for i in range(n):
        s = "tiny" if i == 5 else rng.choice(names[:6] + ["a"] * 5)
        rows.append((i, s, None if i % 50 == 0 else "w " * rng.choice([0, 1, 5, 300, 40])))
    return rows + [(7, "a", "x y z " * 60)] * 20 + [(None, "b", "q"), (None, "b", "q"), (900, "b", "long " * 50000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_are_met(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, text string, size int")
    got = mixing.mix(df).collect()
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=str) == sorted(((i, s, len((t or "").split())) for i, s, t in rows), key=str)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    want = brute_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source]
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(2 * mixing.BLOCK, 0.01 * want[s]), s
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("x"))
    got = [r.x for r in df.collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != list(range(n))


def test_empty(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    r = mixing.mix(spark.createDataFrame([(1, None, None), (2, "a", " ")], schema)).collect()
    assert sorted((x.doc_id, x["size"], x.taken, x.target) for x in r) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
