from __future__ import annotations

import random
from collections import defaultdict

import pytest

from dipfold.llm import repeats


def brute(rows, least):
    where = defaultdict(set)
    for r, (_, t) in enumerate(rows):
        w = (t or "").split(" ")
        w = [x for x in w if x]
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add((r, i))
    marked = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for r, i in places:
                marked[r] |= set(range(i, i + least))
    out = []
    for r, (i, t) in enumerate(rows):
        n = len([x for x in (t or "").split(" ") if x])
        spans, run = [], None
        for k in range(n + 1):
            if k in marked[r] and run is None:
                run = k
            elif k not in marked[r] and run is not None:
                spans.append(f"{run}-{k}")
                run = None
        out.append((i, n, sum(u[1] == t for u in rows), len(marked[r]), len(spans), " ".join(spans), bool(spans)))
    return sorted(out, key=str)


def corpus(seed, least):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(500)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [say(least + k) for k in (0, 1, 5, 30)]
    rows = []
    for i in range(60):
        t = say(rng.randrange(0, 4 * least))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, 3)
            k = rng.randrange(len(t) + 1)
            t[k:k] = p[a:] if rng.random() < 0.5 else p[: len(p) - a]
        rows.append((i, " ".join(t)))
    near = say(6 * least)
    for i in range(60, 90):  # near copies with edits at many places: partners differ to the left and to the right
        t = list(near)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "least", "k"), [(1, 12, 3), (2, 12, 4), (3, 20, 3)])
def test_equals_brute_force(spark, seed, least, k):
    rows = corpus(seed, least)
    rows += [(100, None), (101, ""), (102, "one"), (None, rows[0][1]), (103, rows[65][1]), (103, rows[65][1])]
    rows += [(104, "again " * 50), (105, " ".join(f"x{i % 30}" for i in range(100))), (106, " ".join(f"z{i}" for i in range(30000)))]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in repeats.judge(df, least, k).collect()), key=str)
    want = brute(rows, least)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, bad[:3]


def test_very_long_texts_and_clashing_columns(spark):
    """Two texts of 60,000 words share a passage and one repeats itself; columns have the names that are used inside."""
    from pyspark.sql import functions as F

    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage, again = say(60), say(55)
    rows = [(1, " ".join(say(30_000) + passage + say(30_000))), (2, " ".join(say(100) + passage + say(59_000) + again + say(10) + again)), (3, " ".join(say(40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    odd = df.withColumns({c: F.lit("?") for c in ("n_words", "copies", "SPANS", "row", "digest", "id", "at", "seed", "h", "key", "left", "right", "text_id", "node", "place")})
    want = brute(rows, repeats.MIN_MATCH)
    for d in (df, odd):
        assert sorted((tuple(r) for r in repeats.judge(d).collect()), key=str) == want
    assert [w[4] for w in want] == [1, 3, 0]


def test_empty(spark):
    assert repeats.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
