"""Operator 13. MinHash near-duplicates with circulant signatures.

A signature takes two permutations of the universe of hashed shingles, 0 .. 2**32 - 1, and no more. The first one (``spread``) breaks up whatever order
the shingles have. The second one (``order``) ranks them, and the k-th coordinate is the smallest rank after the second permutation has been shifted
k places in a circle: the smallest of ``order(spread(x) + k mod 2**32)``. Each coordinate is shared by two sets with their similarity as the
probability.

Texts with equal sets are one node. Signatures are cut into bands, nodes with an equal band are a list; within a list, signatures that share
enough coordinates are candidates. They decide nothing: links are confirmed on full sets (:mod:`similar_sets`). At 25 bands of 5 a pair of
similarity 0.85 is missed by all of them with probability 0.0000005, and falls below the candidates' tally with about as much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfold.llm import similar_sets
from dipfold.llm.common import cut, map_texts
from dipfold.llm.components import connected_components
from dipfold.llm.similar_sets import LINKS, SEED, TILE, TILE_SHINGLES, Measure, shingles

#: Three words, similar to 0.85 or more.
MEASURE = Measure(shingle=3, part=85, whole=100, bands=25, rows=5)
BLOCK = 1024


def spread(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


def order(y: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit numbers; works in place."""
    y ^= y >> np.uint32(16)
    y *= np.uint32(0x7FEB352D)
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x846CA68B)
    y ^= y >> np.uint32(16)
    return y


def signature(h: np.ndarray, coordinates: int) -> bytes:
    """``coordinates`` smallest shifted ranks of a set of 64-bit hashes, four bytes each."""
    x = spread((h >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), BLOCK):
        out = np.minimum(out, order(x[None, k : k + BLOCK] + shifts).min(axis=1))
    return out.astype("<u4").tobytes()


def set_digest(h: np.ndarray) -> int:
    """A number of a whole set: equal sets, and by chance of 64 bits no others, have it alike."""
    import xxhash

    digest = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    return digest - (1 << 64) if digest >> 63 else digest


def _forest(nodes: np.ndarray, rows: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the candidates among ``nodes``, found by growing one tree after another from what is not yet reached."""
    left, right, free = [], [], np.ones(len(nodes), bool)
    for i in range(len(nodes)):
        if not free[i]:
            continue
        free[i] = False
        reached = [i]
        while reached:
            j = reached.pop()
            rest = np.flatnonzero(free)
            if not len(rest):
                break
            near = rest[(rows[rest] == rows[j]).mean(axis=1) >= least]
            free[near] = False
            left += [nodes[j]] * len(near)
            right += nodes[near].tolist()
            reached += near.tolist()
    return left, right


def candidates(nodes: DataFrame, measure: Measure, tile: int = TILE) -> DataFrame:
    """``(a, b)``: candidates between the rows ``(node, sketch)`` that hold together whatever all candidates hold together.

    A list of at most ``tile`` nodes gives a spanning forest of its candidates. A longer list is one candidate group as it is: how many of it are
    near copies is decided on whole sets, which does not take longer for its length (:mod:`similar_sets`).
    """
    width = 4 * measure.rows
    band = lambda k: F.xxhash64(F.lit(k), F.substring("sketch", width * k + 1, width))
    postings = nodes.select("node", F.explode(F.array(*(band(k) for k in range(measure.bands)))).alias("list"))
    lists = cut(postings.groupBy("list").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1"), "lists")
    dealt = postings.join(lists, "list")
    sorted_ = dealt.where(F.col("n") <= tile).select("list", "node").join(nodes, "node").repartition("list").sortWithinPartitions("list")
    least, coordinates = measure.least, measure.coordinates

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        now = None

        def found() -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(held.values()), "<u4").reshape(len(held), coordinates)
            return similar_sets._pairs(*_forest(np.array(list(held), np.int64), rows, least))

        for batch in batches:
            for key, node, s in zip(*(batch.column(c).to_pylist() for c in ("list", "node", "sketch")), strict=True):
                if key != now:
                    if len(held) > 1:
                        yield found()
                    held, now = {}, key
                held[node] = s
        if len(held) > 1:
            yield found()

    short = sorted_.mapInArrow(work, LINKS)
    return short.union(dealt.where((F.col("n") > tile) & (F.col("node") != F.col("first"))).select("first", "node").distinct())


def signed(docs: DataFrame, measure: Measure) -> DataFrame:
    """``(doc_id, node, same, size, sketch)`` for each row of ``docs``: a number of the text, one of its set, the set's size and signature (null without a word)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, measure.shingle) for t in batch.column("text").to_pylist()]
        same = [None if h is None else set_digest(h) for h in found]
        sketches = [None if h is None else signature(h, measure.coordinates) for h in found]
        cols = [pa.array(same, pa.int64()), pa.array([0 if h is None else len(h) for h in found], pa.int64()), pa.array(sketches, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), *cols], ["doc_id", "node", "same", "size", "sketch"])

    return map_texts(by_text(docs), work, "doc_id long, node long, same long, size long, sketch binary")


def by_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("node"))


def near_duplicates(docs: DataFrame, measure: Measure = MEASURE, tile: int = TILE, most: int = TILE_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    * ``n_shingles`` is the size of the set of different shingles; a text of fewer words is one shingle. Sets similar to ``part / whole`` or more are
      linked, confirmed on full sets; ``component_id`` is the smallest ``doc_id`` that can be reached, the row itself included.
    * A null text and a text without a word have an empty set, 0 shingles, and are linked with nothing: ``component_id`` is their own id.
    * A row with a null ``doc_id`` is linked by its text and takes its component's name, but never gives one; a component of such rows alone has a null
      name and none is ``kept``. Repeated rows and rows that share an id are judged each by its text; of a repeated ``doc_id`` each row
      with the component's id is ``kept``.
    * Texts of any length are read whole. Other columns are ignored; an empty table gives an empty result.
    """
    marked = cut(signed(docs, measure), "signed")
    # texts with equal sets are one node, named by one of them
    nodes = marked.where("same IS NOT NULL").groupBy("same").agg(
        F.min("node").alias("node"), F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("sketch").alias("sketch")
    )
    nodes = cut(nodes, "nodes")
    found = candidates(nodes.select("node", "sketch"), measure, tile)
    roots = connected_components(similar_sets.verified(by_text(docs), nodes, found, measure, tile, most)).select("node", "root")
    named = nodes.select("same", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = cut(named.join(names, "root").select("same", "component_id"), "names")
    component = F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = marked.select("doc_id", "same", "size").join(names, "same", "left").withColumn("component_id", component)
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
