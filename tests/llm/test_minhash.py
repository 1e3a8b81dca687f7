from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipfold.llm import minhash, near_copies, similar_sets
from dipfold.llm.common import cut
from dipfold.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def grams(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=3, part=85, whole=100):
    """Smallest ids of the components over all pairs."""
    sets = [grams(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and whole * len(a & b) >= part * len(a | b):
                root[find(i)] = find(j)
    names = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            r = find(i)
            names[r] = min(names.get(r, k), k)
    out = []
    for i, (k, _) in enumerate(rows):
        c = names.get(find(i)) if sets[i] else k
        out.append((k, len(sets[i]), c, k is not None and k == c))
    return sorted(out, key=str)


def got(df, **kwargs):
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **kwargs).collect()), key=str)


def corpus(seed=0, groups=12, most=14):
    """Groups of texts around the threshold: copies with a few words changed, some beyond it, some in chains."""
    rng = random.Random(seed)
    say = lambda n: [f"W{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(groups):
        base = say(rng.choice([1, 2, 3, 8, 60, 200]))
        for _ in range(rng.randrange(1, most)):
            t = list(base)
            for k in rng.sample(range(len(t)), min(len(t), rng.randrange(6))):
                t[k] = f"x{rng.randrange(50)}"
            texts.append(" ".join(t))
            base = t if rng.random() < 0.2 else base
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def template(n, seed=1, shared=150, own=26, blocks=0):
    """Pages on one template, each with words of its own: similar to about 0.73, none a near copy. ``blocks`` parts that half of the pages share."""
    rng = random.Random(seed)
    frame = [f"t{k}" for k in range(shared)]
    extra = [[f"b{j}_{k}" for k in range(12)] for j in range(blocks)]
    return [(i, " ".join(frame + [w for b in extra if rng.random() < 0.5 for w in b] + [f"o{rng.randrange(10**6)}" for _ in range(own)])) for i in range(n)]


@pytest.mark.parametrize("tile", [512, 6])
def test_same_as_brute_force(spark, tile):
    rows = corpus() + [(1000 + i, t) for i, t in template(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert got(df, tile=tile) == want
    assert len({r[2] for r in want}) < len(rows) - 30


@pytest.mark.parametrize("seed", range(2))
def test_long_components_lose_no_link(spark, seed):
    """Everything is one component of candidates, longer than a tile: near copies, chains, templates with shared blocks, strangers."""
    rows = corpus(seed, 10) + [(1000 + i, t) for i, t in template(30, seed, blocks=2)] + [(2000 + i, t) for i, t in template(20, seed, 60, 2)]
    rows = list({" ".join(sorted(map(str, grams(t, 3)))): (i, t) for i, t in rows}.values())
    nodes = spark.createDataFrame([(i, len(grams(t, 3))) for i, t in rows], "node long, size long")
    keyed = spark.createDataFrame(rows, "node long, text string")
    pairs = nodes.select(F.lit(rows[0][0]).cast("long").alias("a"), F.col("node").alias("b"))
    want = {i: c for i, _, c, _ in brute(rows)}
    for tile, most in ((512, 1 << 20), (8, 1 << 20), (512, 900)):
        found = {r.node: r.root for r in connected_components(similar_sets.verified(keyed, nodes, pairs, minhash.MEASURE, tile, most)).collect()}
        assert {i: found.get(i, i) for i, _ in rows} == want
    assert len(set(want.values())) < len(rows)


def test_templated_pages_do_not_meet_each_other(spark):
    """Pages of one template that are no near copies: what is joined grows with the pages, not with their pairs."""
    for n in (60, 240):
        rows = template(n)
        dealt = spark.createDataFrame([(7, 0, i, t) for i, t in rows], "list long, tile long, node long, text string")
        cores = similar_sets._cores(dealt, minhash.MEASURE)
        tiles = spark.createDataFrame([(7, 1)], "list long, tiles long")
        found = cut(similar_sets._differences(dealt, cores, tiles, minhash.MEASURE), "differences")
        assert found.agg(F.max("e")).first()[0] <= 30 < min(len(grams(t, 3)) for _, t in rows)
        each = similar_sets._elements(found)
        assert each.groupBy("h").count().where("count > 1").count() == 0 and each.count() <= 30 * n
        assert similar_sets.long_links(found, minhash.MEASURE).count() == 0


def test_odd_rows(spark):
    """Null ids and texts, wordless texts, short texts, repeated rows, one id with several texts, very long texts, clashing columns, no rows."""
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a"), (5, "A"), (6, "a b"), (7, "a  B"), (8, "a b c"), (None, "a b c"), (None, "q r s t"), (9, " "), (5, "x y z"), (5, "x y z"), (3, "X Y z"), (10, long), (11, long + " end"), (12, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)
    odd = df.withColumns({c: F.lit("?") for c in ("node", "same", "size", "sketch", "FIRST", "list", "kept", "component_id", "n_shingles")})
    assert got(odd) == brute(rows)
    assert got(df.limit(0)) == []


def test_coordinates_are_minima_over_shifted_permutations():
    """Both orders are permutations (told on their inverses' images), coordinates are shared with the similarity as probability."""
    x = np.random.default_rng(0).choice(1 << 32, 200_000, replace=False).astype(np.uint32)
    assert len(np.unique(minhash.spread(x))) == len(np.unique(minhash.order(x.copy()))) == len(x)
    h = np.random.default_rng(1).integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2)
    want = [min(int(minhash.order(np.array([(int(minhash.spread(np.array([v >> np.uint64(32)], np.uint32))[0]) + k) % 2**32], np.uint32))[0]) for v in h[:50]) for k in range(8)]
    assert np.frombuffer(minhash.signature(h[:50], 8), "<u4").tolist() == want
    a, b = (np.frombuffer(minhash.signature(part, 2000), "<u4") for part in (h[:500], h[100:]))
    assert abs((a == b).mean() - 400 / 600) < 0.05


def test_bands_miss_next_to_nothing():
    for m in (minhash.MEASURE, near_copies.MEASURE):
        assert (1 - (m.part / m.whole) ** m.rows) ** m.bands < 1e-5 and 0.55 < m.least < m.part / m.whole
