"""Links that the three bits of operator 3 cannot reach: texts whose five-word shingles are similar to 0.8 or more.

Such texts differ in about ten bits of a 64-bit SimHash, where no positional byte need be shared. Candidates are therefore searched in the
positional inverted index of another signature of the text, its circulant MinHash (:mod:`minhash`): two texts of similarity s share each of its
coordinates with probability s. Lists are read four positions at a time (24 lists for each text: a pair of similarity 0.8 is missed by all of them
with probability 0.000003), shared positions are tallied, and pairs that share enough of them are candidates.

The signature decides nothing: whole shingle sets are compared (:mod:`similar_sets`), and only pairs that are similar to 0.8 or more are links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfold.llm import minhash, similar_sets
from dipfold.llm.common import WORD, cut, map_texts
from dipfold.llm.components import connected_components
from dipfold.llm.similar_sets import Measure, shingles

#: Texts whose shingle sets share this part (4 of 5) of their union are near copies.
MEASURE = Measure(shingle=5, part=4, whole=5, bands=24, rows=4)


def signatures(keyed: DataFrame, fingerprint: Callable[[str | None], int] | None = None) -> DataFrame:
    """``(doc_id, node, fp, same, size, sketch)`` for each row of ``keyed`` (``doc_id, text, node``), in one pass over the texts.

    ``same`` is a hash of the whole shingle set, ``size`` its number of shingles; ``sketch`` is null without a word; ``fp`` is null
    without a ``fingerprint``.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = [shingles(t, MEASURE.shingle) for t in texts]
        same = pa.array([0 if h is None else minhash.set_digest(h) for h in found], pa.int64())
        sizes = pa.array([0 if h is None else len(h) for h in found], pa.int64())
        sketched = pa.array([None if h is None else minhash.signature(h, MEASURE.coordinates) for h in found], pa.binary())
        fps = pa.nulls(len(texts), pa.int64()) if fingerprint is None else pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), fps, same, sizes, sketched], ["doc_id", "node", "fp", "same", "size", "sketch"])

    return map_texts(keyed.select("doc_id", "text", "node"), work, "doc_id long, node long, fp long, same long, size long, sketch binary")


def alike(keyed: DataFrame, marked: DataFrame, tile: int = similar_sets.TILE, most: int = similar_sets.TILE_SHINGLES) -> DataFrame:
    """``(a, b)``: links between the values of ``node``, a number of each text of ``keyed``, that join equal shingle sets and near copies.

    ``marked`` is what :func:`signatures` gives for ``keyed``, written down.
    """
    marked = marked.where("sketch IS NOT NULL")
    low = F.min("node").alias("node")
    nodes = cut(marked.groupBy("same").agg(F.first("sketch").alias("sketch"), F.first("size").alias("size"), low), "nodes")
    equal = marked.select("node", "same").join(nodes.select("same", F.col("node").alias("low")), "same")
    near = similar_sets.verified(keyed, nodes, minhash.candidates(nodes.select("node", "sketch"), MEASURE, tile), MEASURE, tile, most)
    return near.union(equal.where("node <> low").select("node", "low").distinct())


def groups(docs: DataFrame, tile: int = similar_sets.TILE, most: int = similar_sets.TILE_SHINGLES) -> DataFrame:
    """``(doc_id, first)`` for rows with a near copy or an equal shingle set: the smallest id of their group.

    Null ids and texts without a word are left out; repeated rows and a repeated id count by their texts, each row by itself; texts of
    any length are compared whole; ties do not arise, since groups are components; other columns are ignored; an empty table gives an
    empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("node")).where(F.col("doc_id").isNotNull() & F.col("text").rlike(WORD))
    roots = connected_components(alike(keyed, cut(signatures(keyed), "sketches"), tile, most)).select("node", "root")
    rows = cut(keyed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")), "rows")
    names = rows.groupBy("root").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(names, "root").select("doc_id", "first")
