from __future__ import annotations

import random
import re

import pytest
import xxhash

from dipfold.llm import simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    first = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    return sorted(((rows[i][0], f"{fps[i]:016x}", first[comp[i]]) for i in range(len(rows))), key=str)


def near_corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(400)) for _ in range(8)]
    rows = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    return rows


EDGES = [
    (100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "One two"), (105, "ONE two three"), (106, "one  two three"),
    (107, "a b c " * 5000), (None, "one"), (None, "unseen words only here"), (108, "É é É"), (108, "É é É"), (90, "one"),
]


def test_equals_brute_force(spark):
    rows = near_corpus() + EDGES
    df = spark.createDataFrame([(i, t, 1, "b", 2) for i, t in rows], "doc_id long, text string, fp int, block string, component_id int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def brute_groups(fps):
    """Components of links of at most three bits, of the values that have one."""
    root = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    size = {r: sum(v == r for v in root.values()) for r in set(root.values())}
    return {frozenset(k for k, v in root.items() if v == r) for r, n in size.items() if n > 1}


@pytest.mark.parametrize("longest", [2048, 16, 3])
def test_long_lists_are_read_by_more_bits_and_lose_no_link(spark, longest):
    """One hot group whose fingerprints differ in few bits, chains between its parts, and strangers."""
    from dipfold.llm.components import connected_components

    rng = random.Random(3)
    base, wide = rng.getrandbits(64), rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(0, 4))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(30)}
    fps |= {wide ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(60)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {}
    for r in connected_components(simhash.links(df, longest)).collect():
        got.setdefault(r.root, set()).add(r.node % (1 << 64))
    assert {frozenset(g) for g in got.values()} == brute_groups(fps)


def test_each_step_shares_one_more_group_of_bits():
    """Whatever three bits differ, one of the deeper masks leaves them out; four steps leave few enough values for one list."""
    from itertools import combinations

    masks = [sum(0xFF << (8 * p) for p in b) for b in simhash.BLOCKS]
    for _ in range(4):
        masks = sorted({d for m in masks for d in simhash.deeper(m)})
    assert all(1 << (64 - m.bit_count()) <= simhash.LIST for m in masks)
    for m in (simhash.deeper(sum(0xFF << (8 * p) for p in simhash.BLOCKS[3]))[1], masks[5]):
        rest = [b for b in range(64) if not m >> b & 1]
        assert all(any(all(not d >> b & 1 for b in c) for d in simhash.deeper(m)) for c in combinations(rest, 3))


def test_blocks_meet_every_five_positions():
    from itertools import combinations

    assert all(any(set(b) <= set(c) for b in simhash.BLOCKS) for c in combinations(range(8), 5))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.first_of_group(df).count() == 0


def test_one_of_each_group_stays(spark):
    from . import test_near_copies

    rows = near_corpus(n=30) + EDGES
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.first_of_group(df).collect()]
    named = [r for r in rows if r[0] is not None]
    assert test_near_copies.brute_heads(named, 0.8) == {i for i, _ in kept if i is not None}
    assert [t for i, t in kept if i is None] == ["unseen words only here"]  # the other unnamed row is a copy of a named one
    assert len(kept) == len(set(kept))


def test_rows_without_or_with_a_repeated_id_are_judged_by_their_own_text(spark):
    say = lambda k: " ".join(f"t{k}x{i}" for i in range(80))
    rows = [(None, say(1), 1), (None, say(2), 1), (None, say(1), 2), (7, say(3), 1), (7, say(4), 1), (8, say(3), 1), (9, say(5), 1), (None, say(5), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = sorted((tuple(r) for r in simhash.first_of_group(df).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[3], rows[4], rows[6]], key=str)
    # one id with two texts of one group: one of them; nothing repeated: the way by a semi-join
    near = say(6).replace("t6x79", "other")
    few = [(1, say(6), 1), (1, near, 1), (2, say(7), 1), (3, None, 1), (4, "", 1)]
    got = [tuple(r) for r in simhash.first_of_group(spark.createDataFrame(few, df.schema)).collect()]
    assert len(got) == 3 and {r[0] for r in got} == {1, 2, 3}


def test_columns_of_any_name_and_type_stay(spark):
    """Internal names, maps and arrays; with repeated rows and without."""
    say = lambda k: " ".join(f"t{k}x{i}" for i in range(60))
    names = ("head_id", "head_node", "row", "node", "root", "fp", "n", "first")
    schema = "doc_id long, text string, m map<string,int>, a array<map<int,int>>, " + ", ".join(f"{n} string" for n in names)
    row = lambda i, k, m: (i, say(k), {"k": m}, [{1: m}], *(f"{n}{i}" for n in names))
    rows = [row(1, 1, 5), row(2, 1, 1), row(3, 2, 1), row(None, 3, 1)]
    for extra, want in (([], [0, 2, 3]), ([row(1, 1, 4), row(1, 1, 4), row(None, 3, 1)], [4, 2, 3])):
        df = spark.createDataFrame(rows + extra, schema)
        out = simhash.first_of_group(df)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((rows + extra)[k]) for k in want)


def test_a_very_long_text_is_grouped_whole(spark):
    base = [f"w{i}" for i in range(400_000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-2], "x", "y"])), (3, " ".join(base[:250_000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.first_of_group(df).collect()) == [1, 3]


@pytest.mark.parametrize("text", ["", "x", "Hello WORLD again", "ü Ü\x1cy a\x0bb c", "a " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)
