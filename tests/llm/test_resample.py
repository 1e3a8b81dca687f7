from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from dipfold.llm import resample

SCHEMA = "doc_id long, text string"


def bag(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def brute(docs, target):
    own, want = Counter(), Counter()
    for _, t in docs:
        own.update(bag(t)[1])
    for t in target:
        want.update(bag(t)[1])
    n, m = sum(own.values()) + 10000, sum(want.values()) + 10000
    gain = [math.floor(1000 * math.log((want[b] + 1.0) * n / ((own[b] + 1.0) * m))) for b in range(10000)]
    rows = []
    for i, t in docs:
        words, b = bag(t)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        u = (int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        rows.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(words)])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus(seed=0, n=300):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(["Alpha", "beta,", "Ünder", "γ", "x-1", "10", "the", "OF"]) + rng.choice(["", "s", "\t"]) for _ in range(k))
    return [(i, say(rng.choice([0, 3, 19, 20, 21, 60]))) for i in range(n)]


def got(spark, docs, target):
    out = resample.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_same_as_brute_force(spark):
    docs, target = corpus(), [t for _, t in corpus(1, 20)] + [None, ""]
    found = got(spark, docs, target)
    assert found == brute(docs, target)
    assert sum(r[4] is not None for r in found) > 20


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, one id with several texts, very long texts; ranks stay without gaps."""
    long = "alpha Beta " * 100_000
    docs = [(None, None), (None, long), (None, long), (4, ""), *[(5, "to be or not " * 10)] * 50, (5, "or else " * 15), (6, "!?" * 50), *corpus(2, 40)]
    found = got(spark, docs, [long])
    assert found == brute(docs, [long])
    ranks = sorted(r[4] for r in found if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1))


def test_empty_tables_and_clashing_columns(spark):
    docs = corpus(3, 60)
    assert got(spark, [], ["a b"]) == []
    assert got(spark, docs, []) == brute(docs, [])
    d = spark.createDataFrame(docs, SCHEMA)
    odd = d.withColumns({c: F.lit(3) for c in ("score", "n_words", "n_features", "buckets", "WEIGHT", "rank", "n", "copies", "above", "first", "block")})
    assert sorted((tuple(r) for r in resample.resample(odd, d.select("text")).collect()), key=str) == brute(docs, [t for _, t in docs])


def test_bytes_are_the_classes_of_the_pattern():
    """Words of the byte table and of the regular expression are the same for all of ASCII and beyond."""
    text = "".join(f"a{chr(c)}B" for c in [*range(1, 256), 0x20AC, 0x1F600])
    assert resample.buckets_of(text)[0] == len(bag(text)[0])
    assert sorted(resample.buckets_of(text)[1].tolist()) == sorted(bag(text)[1])
