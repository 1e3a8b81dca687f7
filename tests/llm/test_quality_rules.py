from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from dipfold.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    tri = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    marked = {i + k for i in range(n - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spans, longest = set(), 0
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= q.MIN_REPEAT:
                spans |= set(range(i, i + k))
    failed = n < 50 or 100 * len(marked) > 50 * n
    fits = len(spans) <= q.MAX_COVERED * n and longest <= max(q.LONGEST_ALLOWED, q.MAX_LONGEST * n)
    return (n, sum(map(len, words)), sum(text.count(c) for c in q.SYMBOLS), len(lines) - len(set(lines)), len(marked), failed, len(spans), longest, not failed and fits)


def texts():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)] + ["#", "a|b", "é"]
    out = [None, "", " \n\t", "one", "a a a a", "a\x1cb c", "x y z x y z", "l 1\nl 1\n\nl 1\n \n "]
    for _ in range(30):
        t = [rng.choice(vocab) for _ in range(rng.randrange(1, 120))]
        if rng.random() < 0.6:
            k, m = rng.randrange(len(t)), rng.randrange(1, 40)
            t += t[k : k + m] * rng.randrange(1, 3)
        out.append(" ".join(t).replace(" w7 ", "\n"))
    return out


def test_equals_brute_force(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(texts())] + [(None, "null id", "x", 0), (3, "one", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = sorted((tuple(r) for r in q.judge(df).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    kept = sorted((tuple(r) for r in q.keep(df).collect()), key=str)
    assert kept == sorted((r for r in rows if brute(r[1])[-1]), key=str)


def test_empty(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("k", [1, 2, 7])
def test_periodic_long_text(k):
    n = 200_000
    got = q._in_batch([" ".join(f"p{i % k}" for i in range(n))])
    assert got["longest_repeat"][0] == n - k and got["repeat_words"][0] == n and not got["kept"][0]
