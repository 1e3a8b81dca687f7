"""Exact links between sets of shingles that candidates hold together.

Members of a component of candidates are compared as whole sets. A component that fits into one tile is compared where it lies. A longer one is
not cut into pairs of tiles, and texts are not brought together pair by pair; its members are described by how they differ from what most of
them share:

* The *core* of a component is what most members of one of its tiles have. Each member becomes its difference from the core, the shingles that
  only one of the two has. A text on a template, or a near copy, is then a few shingles.
* With ``e`` shingles of difference and ``n`` shingles in all, let ``g = e - r n``, where two sets are similar enough if the shingles that only one
  has are at most ``r`` of both sizes together. Two members with ``g + g' <= 0`` are links whatever their differences are. If there is such a pair, both
  are linked in the same way with the member of the smallest ``g``, so one link for each member says it all.
* Any other pair needs more than nothing in common *in the differences*: at least ``(g + g') / 2``. Such pairs are found by a prefix filter: of the
  differences, rarest first, all but the last few that could not be enough by themselves are joined by value. What a template shares is in no
  difference, so pages on one template that are no near copies do not meet at all.
* Pairs found are decided on the exact overlap of their differences.

Nothing depends on a good core: it only makes the differences short. ``r`` and ``g`` are kept in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipfold.llm.common import cut, slices
from dipfold.llm.components import connected_components

SEED = 77
#: Members and shingles of a component that are compared at once; longer ones are described by their differences.
TILE, TILE_SHINGLES = 512, 1 << 20
LINKS = "a long, b long"


class Measure(NamedTuple):
    """Which texts are near copies: shingles of ``shingle`` words whose shared part of the union is ``part / whole`` or more; and how candidates are searched."""

    shingle: int
    part: int
    whole: int
    bands: int
    rows: int

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def least(self) -> float:
        """Part of shared coordinates that makes a candidate: five deviations below the similarity."""
        s = self.part / self.whole
        return s - 5 * (s * (1 - s) / self.coordinates) ** 0.5


def shingles(text: str | None, shingle: int) -> np.ndarray | None:
    """The hashes of the different shingles, sorted; None without a word. Fewer words than a shingle make one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return None
    digest = xxhash.xxh64_intdigest
    groups = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.unique(np.array([digest(b" ".join(g), SEED) for g in groups], np.uint64))


def spanning(nodes: list[int], sets: list[np.ndarray], measure: Measure) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among ``nodes``, whose whole shingle sets are compared."""
    sizes = np.array([len(h) for h in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mine = np.zeros(int(ids.max()) + 1, np.int64)
    left, right, free = [], [], np.ones(len(nodes), bool)
    for i in range(len(nodes)):
        if not free[i]:
            continue
        free[i] = False
        reached = [i]
        while reached and free.any():
            j = reached.pop()
            own = ids[starts[j] : starts[j] + sizes[j]]
            mine[own] = 1
            shared = np.add.reduceat(mine[ids], starts)
            mine[own] = 0
            near = np.flatnonzero(free & ((measure.part + measure.whole) * shared >= measure.part * (sizes + sizes[j])))
            free[near] = False
            left += [nodes[j]] * len(near)
            right += [nodes[k] for k in near]
            reached += near.tolist()
    return left, right


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[tuple, dict[int, np.ndarray]]]:
    """Rows sorted by ``(list, tile)``: the shingle sets of one group at a time, bounded by the tiles."""
    held: dict[int, np.ndarray] = {}
    now = None
    for batch in batches:
        for root, tile, node, text in zip(*(batch.column(c) for c in ("list", "tile", "node", "text")), strict=True):
            key = root.as_py(), tile.as_py()
            if key != now:
                if held:
                    yield now, held
                held, now = {}, key
            held[node.as_py()] = shingles(text.as_py(), shingle)
    if held:
        yield now, held


def _by_tile(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("list", "tile").sortWithinPartitions("list", "tile")


def _short(dealt: DataFrame, measure: Measure) -> DataFrame:
    """Links within each tile of ``list, tile, node, text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches, measure.shingle):
            if len(held) > 1:
                yield _pairs(*spanning(list(held), list(held.values()), measure))

    return _by_tile(dealt).mapInArrow(work, LINKS)


def _cores(dealt: DataFrame, measure: Measure) -> DataFrame:
    """``(list, core)``: the shingles that more than half of a tile's members have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (root, _), held in _groups(batches, measure.shingle):
            values, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            core = values[2 * n > len(held)]
            yield pa.RecordBatch.from_arrays([pa.array([root], pa.int64()), pa.array([core.tobytes()], pa.binary())], ["list", "core"])

    return _by_tile(dealt).mapInArrow(work, "list long, core binary")


def _differences(dealt: DataFrame, cores: DataFrame, tiles: DataFrame, measure: Measure) -> DataFrame:
    """``(list, node, n, e, g, rest)``: how each member of a long component differs from its core.

    A tile gets its component's core as its first row, so a core is sent once for each tile and never to all tasks.
    """
    names = ["list", "node", "n", "e", "g", "rest"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, core = None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            out = []
            for root, tile, node, text, sent in zip(*(batch.column(c) for c in ("list", "tile", "node", "text", "core")), strict=True):
                key = root.as_py(), tile.as_py()
                if key != now:
                    now, core = key, np.zeros(0, np.uint64)
                if sent.is_valid:
                    core = np.frombuffer(sent.as_py(), np.uint64)
                    continue
                own = shingles(text.as_py(), measure.shingle)
                rest = np.setxor1d(own, core, assume_unique=True)
                g = (measure.whole + measure.part) * len(rest) - (measure.whole - measure.part) * len(own)
                out.append((key[0], node.as_py(), len(own), len(rest), g, rest.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    first = cores.join(tiles, "list").select("list", every.alias("tile"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("string").alias("text"), "core")
    rows = dealt.select("list", "tile", "node", "text", F.lit(None).cast("binary").alias("core")).union(first)
    rows = rows.repartition("list", "tile").sortWithinPartitions("list", "tile", F.asc_nulls_first("node"))
    return rows.mapInArrow(work, "list long, node long, n long, e long, g long, rest binary")


def _elements(found: DataFrame) -> DataFrame:
    """``(list, node, h)`` for each shingle of each difference."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, node, rest in zip(*(batch.column(c) for c in ("list", "node", "rest")), strict=True):
                h = np.frombuffer(rest.as_py(), np.int64)
                for k in range(0, len(h), 1 << 16):
                    part = h[k : k + (1 << 16)]
                    same = [pa.array(np.full(len(part), x.as_py(), np.int64)) for x in (root, node)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(part)], ["list", "node", "h"])

    return found.select("list", "node", "rest").mapInArrow(work, "list long, node long, h long")


def _decided(pairs: DataFrame, found: DataFrame, measure: Measure) -> DataFrame:
    """Those of ``pairs`` that are links by the exact overlap of their differences."""
    both = measure.whole + measure.part

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, g, p, q in zip(*(batch.column(c) for c in ("a", "b", "g", "p", "q")), strict=True):
                shared = len(np.intersect1d(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), assume_unique=True))
                if 2 * both * shared >= g.as_py():
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield _pairs(a, b)

    side = lambda node, g, n, rest: found.select("list", F.col("node").alias(node), F.col("g").alias(g), F.col("n").alias(n), F.col("rest").alias(rest))
    met = pairs.join(side("a", "ga", "na", "p"), ["list", "a"]).join(side("b", "gb", "nb", "q"), ["list", "b"])
    met = met.where(both * F.abs(F.col("na") - F.col("nb")) <= (measure.whole - measure.part) * (F.col("na") + F.col("nb")))
    return met.select("a", "b", (F.col("ga") + F.col("gb")).alias("g"), "p", "q").mapInArrow(work, LINKS)


def long_links(found: DataFrame, measure: Measure) -> DataFrame:
    """Links within each component of ``found`` (what :func:`_differences` gives, written down) that join what all its links join."""
    both = measure.whole + measure.part
    heads = cut(found.groupBy("list").agg(F.min(F.struct("g", "node")).alias("m"), F.max("g").alias("most")).select("list", F.col("m.g").alias("low"), F.col("m.node").alias("head"), "most"), "heads")
    sure = found.select("list", "node", "g").join(heads, "list").where((F.col("g") + F.col("low") <= 0) & (F.col("node") != F.col("head"))).select("head", "node")
    odd = heads.where("most > 0").select("list", "low")
    if odd.isEmpty():
        return sure.toDF("a", "b")
    # as the one with more difference (g > 0), and as the other one: how many shared differences a link needs at least, hence how many are joined
    need = lambda g, by: F.greatest(F.lit(1), F.ceil(g / F.lit(float(by)))).cast("long")
    nodes = found.join(odd, "list").where("e > 0").withColumn("as_more", F.when(F.col("g") > 0, F.col("e") - need(F.col("g") + F.col("low"), 2 * both) + 1))
    nodes = cut(nodes.withColumn("as_less", F.col("e") - need(F.col("g"), both) + 1), "odd")
    each = cut(_elements(nodes), "elements")
    held = each.groupBy("list", "h").agg(F.count("*").alias("held")).where("held > 1")
    own = Window.partitionBy("list", "node")
    placed = each.join(held, ["list", "h"]).withColumn("k", F.row_number().over(own.orderBy("held", "h"))).withColumn("common", F.count("*").over(own))
    # those that no other member has come first in the order and are never joined
    placed = placed.join(nodes.select("list", "node", "e", "g", "as_more", "as_less"), ["list", "node"]).withColumn("k", F.col("k") + F.col("e") - F.col("common"))
    placed = cut(placed.where("k <= as_more OR k <= as_less").select("list", "h", "node", "g", (F.col("k") <= F.col("as_more")).alias("more"), (F.col("k") <= F.col("as_less")).alias("less")), "prefixes")
    more = placed.where("more").select("list", "h", F.col("node").alias("a"), F.col("g").alias("ga"))
    less = placed.where("less").select("list", "h", F.col("node").alias("b"), F.col("g").alias("gb"))
    pairs = more.join(less, ["list", "h"]).where("(gb < ga OR (gb = ga AND b < a)) AND ga + gb > 0").select("list", "a", "b").distinct()
    return sure.toDF("a", "b").union(_decided(cut(pairs, "pairs"), found, measure))


def verified(keyed: DataFrame, nodes: DataFrame, candidates: DataFrame, measure: Measure, tile: int = TILE, most: int = TILE_SHINGLES) -> DataFrame:
    """``(a, b)``: links by whole shingle sets between the rows ``(node, size)`` of ``nodes`` that ``candidates`` hold together.

    ``keyed`` has the texts by ``node``. All pairs that are held together, directly or by others, are decided, and the links join the same
    components as all of theirs do.
    """
    roots = connected_components(candidates).select("node", F.col("root").alias("list"))
    members = cut(nodes.select("node", "size").join(roots, "node"), "members")
    lists = members.groupBy("list").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") / most)).alias("tiles"))
    lists = cut(lists, "lists")
    # a shuffled, sorted join at every size: how much is moved follows the input, and nothing is broadcast on a guess or held in memory
    texts = keyed.select("node", "text").join(members.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    at = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("long")
    dealt = members.select("list", "node").join(lists, "list").select("list", "tiles", at.alias("tile"), "node").join(texts.hint("merge"), "node")
    long = lists.where("tiles > 1")
    if long.isEmpty():
        return _short(dealt, measure)
    dealt = cut(dealt, "dealt")
    crowd = dealt.where("tiles > 1")
    cores = _cores(crowd.where("tile = 0"), measure)
    found = cut(_differences(crowd, cores, long, measure), "differences")
    return _short(dealt.where("tiles = 1"), measure).union(long_links(found, measure))
