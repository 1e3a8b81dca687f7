"""Operator 3. SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight
bytes, so they share at least five *positional bytes*. The index lists fingerprints by positional
bytes, candidates are tallied by how many of the eight they share, pairs below the guaranteed
minimum of five are discarded, and what remains is verified bit by bit.

The list of one positional byte holds 1/256 of all fingerprints, so tallying such single lists pair
by pair is quadratic in the corpus. The lists are therefore read as intersections of four positions: the
fourteen blocks of the Steiner system S(3, 4, 8) leave no three bytes that meet them all, hence every pair
that shares at least five positional bytes meets in at least one block. Nothing is lost, and a list
then holds one fingerprint in 2**32 of unrelated ones.

A list that is long all the same (a large group of near copies with many different fingerprints) is read again in the same way: its
fingerprints differ in at most three of the bits that they need not share, so of four groups of those bits a linked pair shares one
more. Lists of one more shared group are formed until they are short; bits run out after four such steps, so no list is ever longer than
what is compared in memory, and the work for a fingerprint has a bound that does not grow with its group. Each list gives a spanning
forest of its links rather than the links themselves. Components stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfold.llm import near_copies
from dipfold.llm.common import cut, fresh, map_texts
from dipfold.llm.components import connected_components

MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
SHINGLE = 3
SEED = 42
#: Different fingerprints of one list that are compared at once; longer lists are read by more of their bits.
LIST = 2048
#: The blocks of S(3, 4, 8), as byte positions.
BLOCKS = (
    (0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (0, 2, 4, 6), (0, 2, 5, 7), (0, 3, 4, 7), (0, 3, 5, 6),
    (4, 5, 6, 7), (2, 3, 6, 7), (2, 3, 4, 5), (1, 3, 5, 7), (1, 3, 4, 6), (1, 2, 5, 6), (1, 2, 4, 7),
)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned number; 0 for null and for texts without a word."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(g), SEED) for g in zip(*(words[k:] for k in range(shingle)), strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``; ``fp`` is the fingerprint as a signed long. Other columns are ignored."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Of XORed fingerprints: how many of the eight positional bytes are shared."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then verification."""
    x = a ^ b
    keep = shared_bytes(x) >= MIN_BYTES
    keep[keep] = np.bitwise_count(x[keep]) <= MAX_BITS
    return keep


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over all links within ``fps`` (distinct values)."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    for i in range(len(fps) - 1):
        rest = fps[i + 1 :]
        for j in np.flatnonzero(linked(np.full(len(rest), fps[i]), rest)) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(j)
    return fps[left], fps[right]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: the links within each group. Holds one group at a time, and groups are bounded by LIST."""
    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
        bounds = np.concatenate([[0], starts, [len(key)]])
        sizes = np.diff(bounds)
        left, right = [], []
        small = np.repeat(sizes <= 48, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        for d in range(1, min(48, int(sizes.max(initial=0)))):
            a, b = fp[:-d], fp[d:]
            ok = (group[:-d] == group[d:]) & small[:-d]
            a, b = a[ok], b[ok]
            ok = linked(a, b)
            left.append(a[ok])
            right.append(b[ok])
        for g in np.flatnonzero(sizes > 48):
            a, b = forest(np.unique(fp[bounds[g] : bounds[g + 1]]))
            left.append(a)
            right.append(b)
        a = np.concatenate([*left, np.zeros(0, np.uint64)]).view(np.int64)
        b = np.concatenate([*right, np.zeros(0, np.uint64)]).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    key = np.zeros((0, 2), np.int64)
    fp = np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("mask", "part")], axis=1)
        key, fp = np.concatenate([key, own]), np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
        ends = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1))
        if len(ends):
            cut_at = ends[-1] + 1
            yield links(key[:cut_at], fp[:cut_at])
            key, fp = key[cut_at:], fp[cut_at:]
    if len(key):
        yield links(key, fp)


def deeper(mask: int) -> list[int]:
    """``mask`` with one of four groups of its other bits added: values that share it and differ in at most three bits share one of these."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in rest[len(rest) * k // 4 : len(rest) * (k + 1) // 4]) for k in range(4)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, longest: int = LIST) -> DataFrame:
    """``(a, b)``: links between the distinct values of the long column ``fp`` that join the same components as all links do.

    Lists longer than ``longest`` are read by more bits, until the bits left have no more than ``longest`` (or eight) values.
    """
    masks = [sum(0xFF << (8 * p) for p in block) for block in BLOCKS]
    postings = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    key, short = ["mask", "part"], []
    while True:
        postings = postings.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
        lists = cut(postings.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "lists")
        most = 1 << (64 - min(m.bit_count() for m in masks))
        last = most <= max(longest, 8) or lists.where(F.col("n") > longest).isEmpty()
        # a sorted join at every size; the lists that are read on leave this round
        short.append(postings.join((lists if last else lists.where(F.col("n") <= longest)).select(*key).hint("merge"), key))
        if last:
            break
        below = {m: deeper(m) for m in masks}
        steps = fps.sparkSession.createDataFrame([(_signed(m), _signed(d)) for m in masks for d in below[m]], "mask long, more long")  # 3,584 rows at most
        postings = postings.join(lists.where(F.col("n") > longest).select(*key).hint("merge"), key).join(F.broadcast(steps), "mask")
        postings = cut(postings.select("fp", F.col("more").alias("mask")).distinct(), "postings")
        masks = sorted({d for ds in below.values() for d in ds})
    return reduce(DataFrame.union, short).repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``.

    * ``component_id`` is the smallest ``doc_id`` among all rows whose fingerprints can be reached by links of at most
      three differing bits, the row itself included; repeated rows and equal texts are in one component.
    * A null or wordless text has fingerprint zero and is linked like any other.
    * A row with a null ``doc_id`` is kept and labelled; it never gives a component its name, so a component of such
      rows alone has a null ``component_id``.
    * Texts of any length are read whole. An empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    marked = cut(fingerprints(docs, shingle), "fps")
    unique = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique")
    roots = connected_components(links(unique.select("fp"))).select(F.col("node").alias("fp"), "root")
    named = unique.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = cut(
        named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id"), "names"
    )
    return marked.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_group(docs: DataFrame) -> DataFrame:
    """One row of each group stays, whole and unchanged: the one with the smallest ``doc_id``.

    * A group is held together by fingerprints at most three bits apart and by five-word shingles similar to 0.8 or more
      (:mod:`near_copies`). Texts are grouped, not ids: rows that share a ``doc_id`` or have none are each judged by their own text.
    * A row with a null ``doc_id`` stays only where its group has no named one. Ties (one id with several texts of a group) go to the
      smallest digest of the text, repeated rows to the smallest JSON of their other columns; columns of any type are allowed.
    * Null texts and texts without a word are one group (fingerprint zero). Texts of any length are read whole.
    * Columns of any name are kept as they are; an empty table gives an empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("node"))
    marked = cut(near_copies.signatures(keyed, fingerprint), "marked")
    unique = cut(marked.groupBy("fp").agg(F.min("node").alias("low")), "unique")
    equal = marked.join(unique, "fp").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    name = lambda c: unique.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low"))
    near = links(unique.select("fp")).join(name("a"), "a").join(name("b"), "b").select(F.col("a_low").alias("a"), F.col("b_low").alias("b"))
    roots = connected_components(equal.union(near).union(near_copies.alike(keyed, marked))).select("node", "root")
    rows = marked.groupBy("doc_id", "node").agg(F.count("*").alias("n")).join(roots, "node", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "n")).alias("first")
    heads = rows.groupBy(F.coalesce("root", "node").alias("root")).agg(first)
    id_, node, n = fresh(docs, "head_id", "head_node", "head_n")
    heads = cut(heads.select(F.col("first.doc_id").alias(id_), F.col("first.node").alias(node), F.col("first.n").alias(n)), "heads")
    # a shuffled, sorted join at every size: how much is moved follows the input, and nothing is broadcast on a guess or held in memory
    own = (F.xxhash64(docs["text"]) == F.col(node)) & docs["doc_id"].cast("long").eqNullSafe(F.col(id_))
    if heads.where(F.col(n) > 1).isEmpty():
        return docs.join(heads.hint("merge"), own, "left_semi")
    return _one_of_each(docs.join(heads.hint("merge"), own), docs.columns, id_, node)


def _one_of_each(kept: DataFrame, columns: list[str], *key: str) -> DataFrame:
    """Of rows with equal keys, hence equal ids and texts, the one whose other columns are smallest as JSON."""
    (row,) = fresh(kept, "row")
    others = [F.col(c) for c in columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    return kept.groupBy(*key).agg(F.min_by(F.struct(*columns), order).alias(row)).select(*(F.col(row)[c].alias(c) for c in columns))
