from __future__ import annotations

import random

from dipfold.llm import near_copies, simhash


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_heads(rows, least):
    """Smallest ids of the groups held together by fingerprints and by shingles similar to ``least`` or more."""
    from . import test_simhash

    fps = {i: test_simhash.brute_fingerprint(t) for i, t in rows}
    sets = {i: shingles(t) if (t or "").split() else None for i, t in rows}
    root = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if i < j and root[i] != root[j]:
                a, b = sets[i], sets[j]
                alike = a is not None and b is not None and len(a & b) >= least * len(a | b)
                if alike or (fps[i] ^ fps[j]).bit_count() <= 3:
                    low, high = sorted((root[i], root[j]))
                    root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def corpus():
    rng = random.Random(4)
    say = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(12):
        base = say(300)
        for c in range(5 if g < 8 else 1):
            t = list(base)
            for k in rng.sample(range(20, 280), min(c, 3) * 2):
                t[k] = f"x{rng.randrange(10**6)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(t)))
    return rows, group


def test_near_copies_are_found_and_others_left_alone(spark):
    rows, group = corpus()
    for i, t in rows:
        assert all((group[i] == group[j]) or len(shingles(t) & shingles(u)) == 0 for j, u in rows)
    near = {(i, j) for i, t in rows for j, u in rows if i < j and len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(t) | shingles(u))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.doc_id: r["first"] for r in near_copies.groups(df).collect()}
    assert all(group[i] == group[f] for i, f in first.items())
    found = sum(first.get(i, -1) == first.get(j, -2) for i, j in near)
    assert found >= 0.95 * len(near) and len(near) > 30
    kept = sorted(r.doc_id for r in simhash.first_of_group(df).collect())
    assert len({group[i] for i in kept}) == 12 and len(kept) <= 14


def test_tiles_give_the_same_groups(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, few, small = (sorted(tuple(r) for r in near_copies.groups(df, tile, most).collect()) for tile, most in ((512, 1 << 20), (3, 1 << 20), (512, 1000)))
    assert want == few == small and len({f for _, f in want}) == 8


def test_links_are_decided_on_whole_shingle_sets(spark):
    """Pairs from just below 0.8 down to 0.65 stay apart, pairs from 0.8 up are joined, and a chain of close texts joins no more than its links."""
    rng = random.Random(9)
    say = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for g in range(60):
        base = say(204)
        near = list(base)
        for k in rng.sample(range(5, 199, 5), 3 + g % 6):
            near[k] = f"y{rng.randrange(10**6)}"
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(near))]
    long = say(604)
    rows += [(1000 + k, " ".join(long[30 * k : 30 * k + 300])) for k in range(8)]  # neighbours 0.82, the next but one 0.66
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.first_of_group(df).collect()} == brute_heads(rows, 0.8)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (None, "a"), (5, "a b c"), (5, "a b c"), (6, "w " * 100000)]
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, node int, sketch string, same int")
    got = {(r.doc_id, r["first"]) for r in near_copies.groups(df).collect()}
    assert got == {(3, 3), (4, 3), (5, 5)}
    assert near_copies.groups(df.limit(0)).count() == 0
