from __future__ import annotations

import random

import pytest

from dipfold.llm import decontaminate as d
from dipfold.llm.common import table


def brute_tiles(a, b, least):
    """Greedy string tiling by definition: every round marks all longest matches that do not overlap."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        found = []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n >= least:
                    found.append((i, j, n))
        if not found:
            return out
        longest = max(f[2] for f in found)
        for i, j, n in found:
            if n == longest and all(fa[i : i + n]) and all(fb[j : j + n]):
                out.append((i, j, n))
                fa[i : i + n] = [False] * n
                fb[j : j + n] = [False] * n


@pytest.mark.parametrize("seed", range(40))
def test_tiles(seed):
    rng = random.Random(seed)
    a = [rng.choice("abcdef"[: rng.randrange(2, 7)]) for _ in range(rng.randrange(0, 40))]
    b = [rng.choice("abcdef") for _ in range(rng.randrange(0, 60))]
    for _ in range(2):
        if a:
            k = rng.randrange(len(a))
            b = b + a[k : k + 15]
    for least in (2, 3, 5):
        assert sorted(d.tile(a, b, least)) == sorted(brute_tiles(a, b, least))


def test_the_longest_match_is_always_next():
    """Few different words, so that matches cut each other: 5,000 pairs."""
    rng = random.Random(11)
    for _ in range(5000):
        words = "abcd"[: rng.randrange(2, 5)]
        a, b = ([rng.choice(words) for _ in range(rng.randrange(6, 25))] for _ in range(2))
        least = rng.choice((2, 3, 5))
        assert sorted(d.tile(a, b, least)) == sorted(brute_tiles(a, b, least)), (a, b, least)


def brute(rows, items, threshold=d.THRESHOLD, least=d.MIN_MATCH):
    out = []
    items = set(items)
    for i, t in rows:
        words, found = d.words_of(t), []
        for k, x in items:
            own = d.words_of(x)
            tiles = brute_tiles(own, words, least) if len(own) >= least else []
            c = sum(n for _, _, n in tiles) / max(1, len(own))
            if c >= threshold:
                found.append((-c, k is None, k or 0, k, len(tiles)))
        best = min(found, default=(0.0, None, None, None, 0))
        out.append((i, len(found), best[3], -best[0], best[4], bool(found)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(200)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, say(20)) for k in range(6)]
    rows = [(0, None), (1, ""), (2, "w1"), (None, " ".join(say(30)))]
    for i in range(3, 40):
        t, x = say(60), rng.choice(items)[1]
        kind = i % 5
        if kind == 0:
            t[10:10] = x
        elif kind == 1:
            t[10:10], t[50:50] = x[10:], x[:10]  # parts in another order
        elif kind == 2:
            t[10:10] = x[:9]
        elif kind == 3:
            t[20:20] = [w.upper() + "," for w in x]
        rows.append((i, " ".join(t)))
    rows += [rows[5], rows[5], (None, " ".join(items[0][1]))]
    known = [(k, " ".join(x)) for k, x in items] + [(9, None), (10, "w1 w2"), (None, " ".join(items[2][1])), (0, " ".join(items[0][1]))]
    return rows, known


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_brute_force(spark, broadcast):
    rows, items = corpus()
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, item_id int")
    known = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in d.judge(df, known, broadcast=broadcast).collect()), key=str)
    assert got == brute(rows, items)
    kept = sorted((r.doc_id for r in d.clean(df, known, broadcast=broadcast).collect()), key=str)
    assert kept == sorted((r[0] for r in brute(rows, items) if not r[-1]), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_clean_judges_rows_without_or_with_a_repeated_id_by_their_text(spark, broadcast):
    item = "one two three four five six seven eight"
    rows = [(None, f"so {item} it says"), (None, "nothing of it in here at all"), (None, None), (4, item), (4, "words of a wholly different kind here"), (5, "alpha beta gamma delta epsilon zeta")]
    rows = [(*r, "b", {"m": k}, k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bad_row string, row map<string,int>, item int")
    known = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = d.clean(df, known, broadcast=broadcast)
    assert out.columns == df.columns
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_very_long_texts_and_phrases_that_all_items_share(spark, broadcast):
    """Items that begin alike, in texts that repeat that phrase; the text of 300,000 words is read whole."""
    stock = "once upon a time there was a king who had".split()
    items = [(k, " ".join([*stock, *(f"i{k}w{j}" for j in range(20))])) for k in range(300)] + [(900, " ".join(stock)), (901, " ".join(stock))]
    long = [f"v{j}" for j in range(300_000)]
    long[150_000:150_000] = items[7][1].split()
    rows = [(1, " ".join(stock * 400)), (2, " ".join(long)), (3, items[5][1] + " " + " ".join(stock * 50)), (4, " ".join(stock[:4])), (5, " ".join(f"i9w{j}" for j in range(20)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.item_id, r.coverage) for r in d.judge(df, known, broadcast=broadcast).collect()}
    assert got == {1: (2, 900, 1.0), 2: (3, 7, 1.0), 3: (3, 5, 1.0), 4: (0, None, 0.0), 5: (1, 9, 20 / 30)}


@pytest.mark.parametrize("seed", range(30))
def test_probes_lose_no_candidate(seed):
    """Whatever subset of an item's seeds a text shares: if it covers enough, one of the probes is in it."""
    rng = random.Random(seed)
    seeds = [rng.randrange(12) for _ in range(rng.randrange(1, 25))]
    held = {x: rng.randrange(1, 50) for x in seeds}
    for threshold in (0.3, 0.6, 1.0):
        found = d.probes(seeds, [held[x] for x in seeds], 5, threshold)
        for _ in range(200):
            shared = {x for x in set(seeds) if rng.random() < rng.choice([0.2, 0.5, 0.9])}
            words = {p for i, x in enumerate(seeds) if x in shared for p in range(i, i + 5)}
            assert d.coverage(seeds, shared, 5) == len(words)
            assert found & shared or len(words) < threshold * (len(seeds) + 4)


def test_empty(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    for way in (True, False):
        assert d.judge(none, items, broadcast=way).count() == 0
        assert [tuple(r) for r in d.judge(one, items, broadcast=way).collect()] == [(1, 0, None, 0.0, 0, False)]


def test_both_ways_agree_on_documents(spark):
    docs, items = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    a, b = (sorted(map(str, d.judge(docs, items, broadcast=w).collect())) for w in (True, False))
    assert a == b
