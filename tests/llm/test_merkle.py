from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from dipfold.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_path(digests, at):
    """Root over ``digests``, and the sides of the leaf at ``at`` level by level."""
    sides = []
    while len(digests) > 1:
        low = at // 16 * 16
        sides.append(("".join(digests[low:at]), "".join(digests[at + 1 : low + 16])))
        digests = [h(*digests[k : k + 16]) for k in range(0, len(digests), 16)]
        at //= 16
    return digests[0], sides


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
    leaves = {s: [brute_leaf(r) for r in by[s]] for s in names}
    subroots = [brute_path(leaves[s], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        root, upper = brute_path(subroots, k)
        for i, r in enumerate(by[s]):
            _, sides = brute_path(leaves[s], i)
            own = leaves[s][i]
            if r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                own = brute_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in (*sides, *upper):
                own = h(left, own, right)
            out.append((r[0], leaves[s][i], subroots[k], root, h(*(x for side in (*sides, *upper) for x in side)), own, own == root))
    return out


def same(spark, rows):
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def corpus(seed=0, sizes=(("a", 1), ("b", 16), ("ä", 17), ("hot", 600), ("", 3), (None, 5))):
    rng = random.Random(seed)
    rows, ids = [], iter(rng.sample(range(-50, 5000), 2000))
    for s, n in sizes:
        for _ in range(n):
            rows.append((next(ids), s, rng.choice(["en", None, "de"]), rng.choice([None, 7, -1]), rng.choice([None, "", "Ab Ü c", "plain", "X" * rng.randrange(50)])))
    rng.shuffle(rows)
    return rows


def test_same_as_brute_force(spark):
    got = same(spark, corpus())
    assert {g[-1] for g in got} == {True, False}


def test_odd_rows(spark):
    """Null ids, repeated rows, one id with several texts, a very long text."""
    rows = [(None, "s", None, None, None), (None, "s", None, None, "Q"), *[(5, "s", "en", 2, "Hey")] * 40, (5, "s", "en", 2, "Other"), (6, None, None, None, "Long Word " * 200_000)]
    same(spark, rows)
    same(spark, [(1, "only", "en", 1, "X")])
    same(spark, [(i, "only", "en", 1, "X") for i in range(16)])


def test_many_sources(spark):
    same(spark, [(i, f"s{i % 300}", "en", 1, "Some Text") for i in range(700)])


def test_empty_and_clashing_columns(spark):
    d = spark.createDataFrame(corpus()[:40], SCHEMA)
    assert merkle.manifest(d.limit(0)).collect() == []
    odd = d.withColumns({c: F.lit("?") for c in ("idx", "n", "leaf", "row", "named", "name", "digest", "proof", "root", "children", "AT")})
    assert sorted(map(str, merkle.manifest(odd).collect())) == sorted(map(str, merkle.manifest(d).collect()))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_any_partitioning_gives_the_same(spark, parts):
    """Leaves dealt at random: nothing is completed on the map side, all goes through the frontier."""
    leaves = [(True, "x", 5000, i, h(str(i))) for i in range(5000)] + [(False, "", 1, 0, h("lone"))]
    df = spark.createDataFrame(leaves, "named boolean, name string, n long, idx long, digest string").repartition(parts, F.xxhash64("idx"))
    tops = {r.name: r.digest for r in merkle.tree(df).where("top").collect()}
    assert tops == {"x": brute_path([x[4] for x in leaves[:-1]], 0)[0], "": h("lone")}
