"""Boosted trees by gradient histograms, many fits at a time, on tables of any size.

Values are put into bins once; missing values have a bin of their own. Trees grow best leaf first. What a tree has to know about its rows is, for
each open node, feature and bin, the sum of gradients, of hessians and the number of rows: from these the best cut, and the side that missing values
go to, follow. Trees are grown in *waves*: a wave asks for the histograms of all nodes that the tree may split next, so a tree takes as many waves as it is
deep.

Rows are dealt in blocks of at most BLOCK_ROWS. Each block sums its own histograms (the map-side combine), and one ``groupBy(fit, node)`` a wave adds
them up and finds the splits, for all fits at once; the driver holds trees, never rows or histograms. Where all rows are one block there is
nothing to add up between blocks: the same waves then run where the block lies, and fits are dealt over the tasks. There rows of the same bins are one
cell with its numbers of rows, and of two children the larger one's sums are its parent's less its sibling's. Gradients and hessians are whole
multiples of a small grain (:func:`grain_of`), so all these sums are exact in any order. Both ways fit all rows and give the same trees.

A few fits over many blocks do not wait for a job a wave either: once a node has no more rows than a block, its rows meet by ``groupBy(fit, node)`` and
what the waves below it would ask for is answered there (:class:`Below`). The tree is still grown by the same waves, of which most then need no job.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipfold.functions import expressions as X

BINS = 255
LEAST_HESSIAN = 1e-3
#: Rows of one block, about 100 bytes each while a fit runs; a fit of no more rows than that needs no sums over blocks.
BLOCK_ROWS = 1 << 21
#: Rows that one task of a wave reads: blocks of a table of many are dealt over more tasks, each of which sums its own.
TASK_ROWS = 1 << 16
#: Rounds after which the rows' margins are written down, so that no job goes through more trees than that.
SETTLED_ROUNDS = 8
#: Fits of one call up to which rows of small nodes are brought together; more fits share the jobs of their waves, and their rows would be moved for each.
FEW_RUNS = 4
#: Parts of a split, as codes.
TRAIN, TEST, UNUSED = 0, 1, 2


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value, BINS for a missing one. A value equal to an edge lies below it."""
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if edges else np.zeros((len(x), 0), np.int64)
    return np.where(np.isnan(x), BINS, codes).astype(np.uint8)


def edges_of(d: DataFrame, features: list[str]) -> list[list[float]]:
    """Cuts between bins, BINS - 1 at most: the middles between values where these are few, else values at even shares of the rows.

    Laid over all rows once, without their labels: two aggregations, a few hundred numbers.
    """
    if not features:
        return []
    values = d.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f).cast("double").alias("v")) for k, f in enumerate(features)))).alias("x")).select("x.*")
    values = values.where(F.col("v").isNotNull() & ~F.isnan("v"))
    number = values.distinct().groupBy("k").agg(F.count("*").alias("n"))
    few = {r.k for r in number.where(F.col("n") <= BINS).collect()}
    out: list[list[float]] = [[] for _ in features]
    held: dict[int, list[float]] = {k: [] for k in few}
    for r in values.where(F.col("k").isin(list(few))).distinct().collect() if few else []:  # BINS values of a feature at most
        held[r.k].append(r.v)
    for k, own in held.items():
        own = np.array(sorted(own))
        out[k] = ((own[1:] + own[:-1]) / 2).tolist()
    shares = [i / BINS for i in range(1, BINS)]
    for r in values.where(~F.col("k").isin(list(few))).groupBy("k").agg(F.percentile_approx("v", shares, 100_000).alias("q")).collect():
        out[r.k] = sorted(set(r.q))
    return out


def histograms(codes: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int) -> np.ndarray:
    """Sums of gradients, hessians and rows by ``(slot, feature, bin)``; rows of slot -1 are left out."""
    use = np.flatnonzero(slot >= 0)
    width = codes.shape[1]
    at, g, h, own = slot[use] * (width * (BINS + 1)), g[use], h[use], codes[use]
    out = np.empty((3, slots, width, BINS + 1))
    size = slots * width * (BINS + 1)
    flat = [at + (j * (BINS + 1)) + own[:, j] for j in range(width)]
    flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    out[0] = np.bincount(flat, np.tile(g, width), size).reshape(out.shape[1:])
    out[1] = np.bincount(flat, np.tile(h, width), size).reshape(out.shape[1:])
    out[2] = np.bincount(flat, minlength=size).reshape(out.shape[1:])
    return out


def _gains(left: np.ndarray, total: np.ndarray, least: int, l2: float) -> np.ndarray:
    """Scores of both sides of each cut, given the sums of the left; -inf where a side has too few rows."""
    rest = total - left
    score, other = left[0] * left[0], rest[0] * rest[0]
    few = np.minimum(left[2], rest[2]) < least
    few |= np.minimum(left[1], rest[1]) < LEAST_HESSIAN
    with np.errstate(divide="ignore", invalid="ignore"):
        score /= left[1] + l2
        other /= rest[1] + l2
        score += other
    np.copyto(score, -np.inf, where=few)
    return score.reshape(score.shape[0], -1)


def splits(sums: np.ndarray, least: int, l2: float) -> list[tuple | None]:
    """``(gain, feature, bin, missing go left, sums of the left, sums of all)`` of the best split of each slot; None if none is allowed or gains anything.

    Of equal gains the first feature and bin counts, missing values to the right before missing values to the left.
    """
    # a node of fewer rows than two sides need has no split
    out: list[tuple | None] = [None] * sums.shape[1]
    able = np.flatnonzero(sums[2, :, 0].sum(axis=1) >= 2 * least)
    if not len(able):
        return out
    sums = sums[:, able] if len(able) < len(out) else sums
    slots = len(able)
    missing = sums[..., BINS:]
    left = np.cumsum(sums[..., :BINS], axis=3)
    total = left[:, :, :1, -1:] + missing[:, :, :1]
    # the other side for missing values counts only where a feature has any
    some = np.flatnonzero(missing[2, :, :, 0].any(axis=0))
    right = _gains(left, total, least, l2)
    lefts = left[:, :, some] + missing[:, :, some]
    low = _gains(lefts, total, least, l2) if len(some) else np.full((slots, 1), -np.inf)
    for s, (i, j) in enumerate(zip(right.argmax(axis=1).tolist(), low.argmax(axis=1).tolist(), strict=True)):
        g, h = total[:2, s, 0, 0].tolist()
        goes_left = bool(low[s, j] > right[s, i])
        best = float(low[s, j] if goes_left else right[s, i])
        if not best - g * g / max(h + l2, LEAST_HESSIAN) > 1e-12:
            continue
        f, b = divmod(j if goes_left else i, BINS)
        own = (lefts if goes_left else left)[:2, s, f, b].tolist()
        out[able[s]] = (best - g * g / (h + l2), int(some[f]) if goes_left else f, b, goes_left, tuple(own), (g, h))
    return out


def rows_of(sums: np.ndarray, found: tuple | None) -> list[int]:
    """Numbers of rows left and right of the best split of one node, given its sums."""
    if not found:
        return []
    _, f, b, low, _, _ = found
    left = int(sums[2, f, : b + 1].sum() + (sums[2, f, BINS] if low else 0))
    return [left, int(sums[2, f].sum()) - left]


class Growing:
    """One tree that grows best leaf first, and what it has to know next.

    ``wanted`` are the nodes whose best splits are asked for. They are told all at once; then the tree goes on as far as what is known reaches,
    and beyond that as if what is not known gained nothing, so that a wave brings all nodes that may be split next. What was asked for in vain
    stays out of the tree.
    """

    def __init__(self, leaves: int, least: int, l2: float, rate: float):
        self.leaves, self.least, self.l2, self.rate = leaves, least, l2, rate
        self.best: dict[int, tuple | None] = {}
        self.feature, self.at, self.low, self.left, self.right = [-1], [0], [False], [-1], [-1]
        self.sums: list[tuple | None] = [None]
        self.wanted: list[int] = [0]
        self.inner: list[int] = []

    def tell(self, found: dict[int, tuple | None]) -> None:
        """Best splits of ``wanted`` nodes; those without one may be left out."""
        for k in self.wanted:
            self.best[k] = found.get(k)
        heap = [(-self.best[0][0], 0)] if self.best[0] else []
        self.wanted, self.inner = [], []
        while heap and len(self.inner) + 1 < self.leaves:
            _, k = heapq.heappop(heap)
            self.inner.append(k)
            if self.left[k] < 0:
                self._split(k)
            for child in (self.left[k], self.right[k]):
                if child not in self.best:
                    self.wanted.append(child)
                elif self.best[child]:
                    heapq.heappush(heap, (-self.best[child][0], child))

    def _split(self, k: int) -> None:
        _, self.feature[k], self.at[k], self.low[k], left, total = self.best[k]
        self.left[k], self.right[k] = len(self.feature), len(self.feature) + 1
        self.sums[k] = total
        for part in (left, (total[0] - left[0], total[1] - left[1])):
            for column, value in ((self.feature, -1), (self.at, 0), (self.low, False), (self.left, -1), (self.right, -1), (self.sums, part)):
                column.append(value)

    def moved(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The places of rows one level further down, where their nodes have been split."""
        feature = np.array(self.feature)[place]
        go = np.flatnonzero(feature >= 0)
        if not len(go):
            return place
        own, node = codes[go, feature[go]], place[go]
        goes = np.where(own == BINS, np.array(self.low)[node], own <= np.array(self.at)[node])
        place = place.copy()
        place[go] = np.where(goes, np.array(self.left)[node], np.array(self.right)[node])
        return place

    def placed(self, codes: np.ndarray) -> np.ndarray:
        place = np.zeros(len(codes), np.int64)
        while (new := self.moved(codes, place)) is not place:
            place = new
        return place

    def slots(self, place: np.ndarray, nodes: list[int] | None = None) -> np.ndarray:
        """The number of each row's node among the wanted ones (or ``nodes``), -1 elsewhere."""
        nodes = self.wanted if nodes is None else nodes
        number = np.full(len(self.feature), -1)
        number[nodes] = np.arange(len(nodes))
        return number[place]

    def values(self) -> np.ndarray:
        """What each node adds to a margin; nodes below a leaf of the tree add what the leaf does."""
        inner, out = set(self.inner), np.zeros(len(self.feature))
        for k in range(len(self.feature)):
            if self.left[k] < 0:
                continue
            for child in (self.left[k], self.right[k]):
                g, h = self.sums[child]
                out[child] = -self.rate * g / (h + self.l2) if k in inner else out[k]
        return out

    def nodes(self) -> list[list]:
        """``[feature, bin, missing left, left, right, value]`` of the tree's nodes; empty if it has no split."""
        if not self.inner:
            return []
        inner, value, number, out = set(self.inner), self.values(), {0: 0}, [[]]
        for k in sorted(inner):
            for child in (self.left[k], self.right[k]):
                number[child] = len(out)
                out.append([-1, 0, False, -1, -1, float(value[child])])
        for k in inner:
            out[number[k]] = [self.feature[k], self.at[k], self.low[k], number[self.left[k]], number[self.right[k]], 0.0]
        return out


def chance(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # of a margin far below zero: no chance
        return 1 / (1 + np.exp(-margin))


def grain_of(rows: float) -> float:
    """The power of two of which gradients and hessians are multiples, so that sums over ``rows`` of them are exact in doubles: 2**-38 for ten thousand."""
    return 2.0 ** (int(rows).bit_length() - 52)


def derivatives(margin: np.ndarray, grain: float) -> tuple[np.ndarray, np.ndarray]:
    """The chance of label 1 and the hessian at each margin, as multiples of ``grain``; a row's gradient is its chance less its label."""
    p = chance(margin)
    return np.rint(p / grain) * grain, np.rint(p * (1 - p) / grain) * grain


def cells_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct rows, and for each row the number of its own."""
    at, first = np.zeros(len(codes), np.int64), np.arange(min(len(codes), 1))
    for j in range(codes.shape[1]):
        _, first, at = np.unique(at * (BINS + 1) + codes[:, j], return_index=True, return_inverse=True)
    return codes[first], at


def sums_of(columns: list[np.ndarray], own: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of :func:`histograms` over the cells ``own`` of one node."""
    out, weights = np.zeros((3, len(columns), BINS + 1)), (g[own], h[own], n[own])
    for j, column in enumerate(columns):
        bins = column[own].astype(np.int64)
        for k, w in enumerate(weights):
            out[k, j] = np.bincount(bins, w, BINS + 1)
    return out


def grow(tree: Growing, columns: list[np.ndarray], g: np.ndarray, h: np.ndarray, n: np.ndarray) -> dict[int, np.ndarray]:
    """Grow ``tree`` over cells that lie in one place; the cells of each node that was not split."""
    members = {0: np.arange(len(n))}
    sums = {0: sums_of(columns, members[0], g, h, n)}
    while tree.wanted:
        tree.tell(dict(zip(tree.wanted, splits(np.stack([sums[k] for k in tree.wanted], axis=1), tree.least, tree.l2), strict=True)))
        for k in tree.inner:
            if k not in members or tree.left[k] in members:
                continue
            own, left, right = members.pop(k), tree.left[k], tree.right[k]
            bins = columns[tree.feature[k]][own]
            goes = (bins <= tree.at[k]) | (bins == BINS) if tree.low[k] else bins <= tree.at[k]
            members[left], members[right] = own[goes], own[~goes]
            small, large = (left, right) if len(members[left]) <= len(members[right]) else (right, left)
            sums[small] = sums_of(columns, members[small], g, h, n)
            sums[large] = sums.pop(k) - sums[small]
    return members


class Below:
    """Best splits of the nodes of one growing tree that are known before its waves ask for them.

    ``at`` has for a node the answers that came with the rows of a node above it (or its own), and its number among them; the tree's splits lead from one
    to the next. What is not known is asked for by a job. ``rows`` are the numbers of rows of nodes, where a job told them.
    """

    def __init__(self, tree: Growing, rows: int):
        self.tree, self.rows, self.sides = tree, {0: rows}, {}
        self.at: dict[int, tuple[list, int]] = {}

    def put(self, node: int, found: list) -> None:
        """``found`` are ``[best, left, right]`` of the nodes of the tree below ``node``, itself first."""
        self.at[node] = (found, 0)

    def told(self, node: int, sides: list[int]) -> None:
        """Numbers of rows of the two children that a node will have if it is split."""
        self.sides[node] = sides

    def follow(self) -> None:
        """What is known of the children of nodes that were split since."""
        for k in self.tree.inner:
            children = (self.tree.left[k], self.tree.right[k])
            if k in self.at:
                found, own = self.at[k]
                self.at.update({child: (found, there) for child, there in zip(children, found[own][1:], strict=True) if there >= 0})
            else:
                self.rows.update(zip(children, self.sides[k], strict=True))

    def take(self) -> dict[int, tuple | None] | None:
        """The answers of all wanted nodes, None if one is not known."""
        if any(k not in self.at for k in self.tree.wanted):
            return None
        return {k: self.at[k][0][self.at[k][1]][0] for k in self.tree.wanted}


def start_of(share: float) -> float:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return float(np.log(share / (1 - share)))


def fit_block(
    codes: np.ndarray, y: np.ndarray, train: np.ndarray, rounds: int, rate: float, leaves: int, least: int, l2: float, seen: Callable[[int, np.ndarray], None] | None = None
) -> tuple[float, list, np.ndarray]:
    """Start, trees and the margins of all rows of one block, fitted on the rows of ``train``. Log loss, one Newton step a round.

    ``seen`` is told the number of each round and the margins after it.
    """
    start = start_of(float(y[train].mean()) if train.any() else 0.5)
    cells, at = cells_of(codes)
    columns = [np.ascontiguousarray(cells[:, j]) for j in range(codes.shape[1])]
    n = np.bincount(at[train], minlength=len(cells)).astype(float)
    up = np.bincount(at[train], y[train], len(cells))
    margin, trees, grain = np.full(len(cells), start), [], grain_of(n.sum())
    for _ in range(rounds):
        p, h = derivatives(margin, grain)
        g, h = n * p - up, n * h
        tree = Growing(leaves, least, l2, rate)
        members = grow(tree, columns, g, h, n)
        if not tree.inner:
            break
        trees.append(tree.nodes())
        value = tree.values()
        for k, own in members.items():
            margin[own] += value[k]
        if seen:
            seen(len(trees), margin[at])
    return start, trees, margin[at]


def added(trees: list, codes: np.ndarray) -> np.ndarray:
    """What ``trees`` add to the margins of rows.

    Each tree is read as a table of the next node by node and bin, in which leaves lead to themselves: a step down is two look-ups for each row.
    """
    out, bins = np.zeros(len(codes)), np.arange(BINS + 1)
    own, first = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
    for nodes in trees:
        feature, at, low, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
        goes = bins <= at[:, None]
        goes[:, BINS] = low
        below = np.where(goes, left[:, None], right[:, None])
        below = np.where(feature[:, None] >= 0, below, np.arange(len(nodes))[:, None]).ravel()
        column, start = np.maximum(feature, 0), np.arange(len(nodes)) * (BINS + 1)
        here = np.zeros(len(codes), np.int64)
        while (feature[here] >= 0).any():
            here = below[start[here] + own[first + column[here]]]
        out += value[here]
    return out


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    codes = binned(x, [np.asarray(e) for e in model["edges"]])
    return chance(model["start"] + added(model["trees"], codes))


def coded(d: DataFrame, key: str, label: str, features: list[str], parts: list[Column], edges: list[list[float]]) -> DataFrame:
    """``(key, y, codes, parts)`` of the rows with a label: a byte for each feature and for each split."""
    rows = d.where(F.col(label).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("y"), *(F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)),
        *(p.cast("int").alias(f"p{k}") for k, p in enumerate(parts)),
    )
    cuts, n_parts = [np.array(e) for e in edges], len(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.stack([batch.column(f"x{k}").to_pandas().to_numpy(float, na_value=np.nan) for k in range(len(cuts))], axis=1) if cuts else np.zeros((n, 0))
            part = np.stack([batch.column(f"p{k}").to_numpy(zero_copy_only=False) for k in range(n_parts)], axis=1).astype(np.uint8)
            own = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (binned(x, cuts), part)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), *own], ["key", "y", "codes", "parts"])

    return rows.mapInArrow(work, "key long, y int, codes binary, parts binary")


def _bytes(batch: pa.RecordBatch | pa.Table, name: str, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, width)


RUN = "run int, start double, trees string"
SCORES = "run int, key long, label int, score double"


def _in_one_block(rows: DataFrame, runs: list[dict], width: int, splits_: int, models: bool) -> DataFrame:
    """The fits of all runs, a task for each: their models, or the scores of their TEST rows.

    Runs that differ only in their rounds are one fit: the shorter one is the beginning of the longer one.
    """
    alike: dict[str, list[int]] = {}
    for k, r in enumerate(runs):
        alike.setdefault(json.dumps([r["columns"], r["part"], r["params"] | {"rounds": 0}], sort_keys=True), []).append(k)
    fits = list(alike.values())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, part, y = _bytes(batch, "codes", np.uint8, width), _bytes(batch, "parts", np.uint8, splits_), batch.column("y").to_numpy().astype(np.int32)
            for k, (first, *_) in enumerate(fits):
                own = part[:, runs[first]["part"]]
                train, test = np.flatnonzero(own == TRAIN), np.flatnonzero(own == TEST)
                held = np.concatenate([test, train])
                keys = pa.array([[]], pa.list_(pa.int64())) if models else pa.ListArray.from_arrays(pa.array([0, len(test)], pa.int32()), batch.column("key").take(pa.array(test)))
                own = [pa.array([a.tobytes()], pa.binary()) for a in (codes[held][:, runs[first]["columns"]], y[held])]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(test)], pa.int32()), keys, *own], ["run", "tests", "keys", "codes", "y"])

    def work(g: pa.Table) -> pa.Table:
        mine = sorted(fits[g["run"][0].as_py()], key=lambda k: runs[k]["params"]["rounds"])
        run = mine[-1]
        job = runs[run]
        own = [np.frombuffer(b, np.int32) for b in g["y"].to_pylist()]
        y = np.concatenate(own)
        codes = np.frombuffer(b"".join(g["codes"].to_pylist()), np.uint8).reshape(len(y), len(job["columns"]))
        # the TEST rows of each batch lie before its TRAIN rows
        train = np.concatenate([np.arange(len(b)) >= tests for b, tests in zip(own, g["tests"].to_pylist(), strict=True)])
        test = np.flatnonzero(~train)
        stops = {runs[k]["params"]["rounds"]: None for k in mine}

        def seen(n: int, margin: np.ndarray) -> None:
            if n in stops:
                stops[n] = margin[test]

        start, trees, margin = fit_block(codes, y.astype(float), train, **job["params"], seen=seen)
        if models:
            return pa.table([pa.array([run], pa.int32()), pa.array([start]), pa.array([json.dumps(trees)])], ["run", "start", "trees"])
        margins = [stops[runs[k]["params"]["rounds"]] for k in mine]
        score = chance(np.concatenate([margin[test] if m is None else m for m in margins]))
        keys = pa.concat_arrays([g["keys"].combine_chunks().flatten()] * len(mine))
        label = pa.array(np.tile(y[test], len(mine)))
        return pa.table([pa.array(np.repeat(np.array(mine, np.int32), len(test))), keys, label, pa.array(score)], ["run", "key", "label", "score"])

    each = rows.mapInArrow(dealt, "run int, tests int, keys array<long>, codes binary, y binary").repartitionByRange(len(fits), "run")
    return each.groupBy("run").applyInArrow(work, RUN if models else SCORES)


SENT = "run int, node int, sums binary, codes binary, grads binary"


def _sent(run: list, node: list, sums: list, codes: list, grads: list) -> pa.RecordBatch:
    cols = [pa.array(run, pa.int32()), pa.array(node, pa.int32()), *(pa.array(c, pa.binary()) for c in (sums, codes, grads))]
    return pa.RecordBatch.from_arrays(cols, ["run", "node", "sums", "codes", "grads"])


def _margins(batch: pa.RecordBatch, codes: np.ndarray, runs: list[dict], pending: list[list]) -> np.ndarray:
    """The margins of a batch of rows for each run: what was written down, and what the trees since then add."""
    out = _bytes(batch, "margins", np.float64, len(runs)).copy()
    for k, trees in enumerate(pending):
        if trees:
            out[:, k] += added(trees, codes[:, runs[k]["columns"]])
    return out


class _Over:
    """All runs over rows of many blocks: a table of rows with their margins, and the trees that have been added since it was written."""

    def __init__(self, rows: DataFrame, runs: list[dict], width: int, splits_: int, block_rows: int):
        self.runs, self.width, self.splits, self.block_rows = runs, width, splits_, block_rows
        self.starts, self.grains, self.sizes = self._starts(rows)
        at = b"".join(np.float64(s).tobytes() for s in self.starts)
        self.rows = X.kept(rows.withColumn("margins", F.lit(bytearray(at))))
        self.pending: list[list] = [[] for _ in runs]
        self.trees: list[list] = [[] for _ in runs]

    def _starts(self, rows: DataFrame) -> tuple[list[float], list[float], list[int]]:
        """The log odds, the grain and the number of each run's TRAIN rows: labels are counted by split."""
        width = self.splits

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, up = np.zeros(width, np.int64), np.zeros(width, np.int64)
            for batch in batches:
                use = _bytes(batch, "parts", np.uint8, width) == TRAIN
                n += use.sum(axis=0)
                up += (use & (batch.column("y").to_numpy()[:, None] == 1)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(n), pa.array(up)], ["part", "n", "up"])

        found = {r.part: r for r in rows.mapInArrow(work, "part int, n long, up long").groupBy("part").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).collect()}
        share = lambda p: found[p].up / found[p].n if p in found and found[p].n else 0.5
        sizes = [found[r["part"]].n if r["part"] in found else 0 for r in self.runs]
        return [start_of(share(r["part"])) for r in self.runs], [grain_of(n) for n in sizes], sizes

    def wave(self, growing: dict[int, Below]) -> dict[int, dict[int, tuple | None]]:
        """The best splits of all wanted nodes of all runs: histograms by block, added up by one ``groupBy(run, node)``.

        Of few runs, nodes of no more rows than a block send their rows instead, and the answers below them come back with theirs.
        """
        runs, width, splits_, pending, grains = self.runs, self.width, self.splits, self.pending, self.grains
        trees = {k: b.tree for k, b in growing.items()}
        small = {k: [n for n in b.tree.wanted if n in b.at or len(runs) <= FEW_RUNS and b.rows.get(n, self.block_rows + 1) <= self.block_rows] for k, b in growing.items()}
        large = {k: [n for n in t.wanted if n not in small[k]] for k, t in trees.items()}
        gathered = {k: [n for n in nodes if n not in growing[k].at] for k, nodes in small.items()}

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                codes, part = _bytes(batch, "codes", np.uint8, width), _bytes(batch, "parts", np.uint8, splits_)
                at, y = _margins(batch, codes, runs, pending), batch.column("y").to_numpy().astype(float)
                for k, tree in trees.items():
                    use = np.flatnonzero(part[:, runs[k]["part"]] == TRAIN)
                    mine = codes[use][:, runs[k]["columns"]]
                    p, h = derivatives(at[use, k], grains[k])
                    g, place = p - y[use], tree.placed(mine)
                    if large[k]:
                        found = histograms(mine, tree.slots(place, large[k]), g, h, len(large[k]))
                        sums[k] = sums[k] + found if k in sums else found
                    for node in gathered[k]:
                        here = np.flatnonzero(place == node)
                        if len(here):
                            yield _sent([k], [node], [None], [mine[here].tobytes()], [np.stack([g[here], h[here]]).tobytes()])
            for k, found in sums.items():
                nodes = large[k]
                yield _sent([k] * len(nodes), nodes, [found[:, s].tobytes() for s in range(len(nodes))], [None] * len(nodes), [None] * len(nodes))

        def best(g: pa.Table) -> pa.Table:
            run, node = g["run"][0].as_py(), g["node"][0].as_py()
            job = runs[run]
            params = {p: v for p, v in job["params"].items() if p != "rounds"}
            if g["sums"][0].is_valid:
                shape = (3, 1, len(job["columns"]), BINS + 1)
                all_ = sum(np.frombuffer(s.as_py(), float).reshape(shape) for s in g["sums"])
                found = splits(all_, params["least"], params["l2"])[0]
                said = {"best": found, "rows": rows_of(all_[:, 0], found)}
            else:
                codes = np.frombuffer(b"".join(g["codes"].to_pylist()), np.uint8).reshape(-1, len(job["columns"]))
                grads = np.concatenate([np.frombuffer(b, float).reshape(2, -1) for b in g["grads"].to_pylist()], axis=1)
                tree = Growing(**params)
                grow(tree, [np.ascontiguousarray(codes[:, j]) for j in range(codes.shape[1])], *grads, np.ones(len(codes)))
                said = {"below": [[tree.best[k], tree.left[k], tree.right[k]] for k in range(len(tree.feature))]}
            return pa.table([pa.array([run], pa.int32()), pa.array([node], pa.int32()), pa.array([json.dumps(said)])], ["run", "node", "said"])

        found: dict[int, dict[int, tuple | None]] = {k: {} for k in growing}
        blocks = self.rows.mapInArrow(own, SENT)
        for r in blocks.groupBy("run", "node").applyInArrow(best, "run int, node int, said string").collect():  # splits of each wanted node, a tree's at most
            said = json.loads(r.said)
            if "below" in said:
                growing[r.run].put(r.node, said["below"])
            else:
                found[r.run][r.node] = said["best"]
                growing[r.run].told(r.node, said["rows"])
        for k, nodes in small.items():
            at = growing[k].at
            found[k] |= {n: at[n][0][at[n][1]][0] for n in nodes if n in at}
        return found

    def settle(self) -> None:
        """Write the rows with the margins they have now."""
        runs, width, pending = self.runs, self.width, self.pending

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                now = _margins(batch, _bytes(batch, "codes", np.uint8, width), runs, pending)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([m.tobytes() for m in now], pa.binary())], batch.schema.names)

        self.rows = X.kept(self.rows.mapInArrow(work, self.rows.schema))
        self.pending = [[] for _ in self.runs]

    def fit(self, settled: int) -> None:
        left = set(range(len(self.runs)))
        for n in range(max(r["params"]["rounds"] for r in self.runs)):
            left = {k for k in left if n < self.runs[k]["params"]["rounds"]}
            trees = {k: Growing(**{p: v for p, v in self.runs[k]["params"].items() if p != "rounds"}) for k in left}
            below = {k: Below(t, self.sizes[k]) for k, t in trees.items()}
            while growing := {k: b for k, b in below.items() if b.tree.wanted}:
                asked = {k: b for k, b in growing.items() if b.take() is None}
                found = self.wave(asked) if asked else {}
                for k, b in growing.items():
                    b.tree.tell(found[k] if k in found else b.take())
                    b.follow()
            left = {k for k in left if trees[k].inner}
            for k in left:
                self.pending[k].append(trees[k].nodes())
                self.trees[k].append(trees[k].nodes())
            if (n + 1) % settled == 0:
                self.settle()
            if not left:
                break

    def scores(self) -> DataFrame:
        runs, width, splits_, pending = self.runs, self.width, self.splits, self.pending

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, part = _bytes(batch, "codes", np.uint8, width), _bytes(batch, "parts", np.uint8, splits_)
                at = _margins(batch, codes, runs, pending)
                for k, job in enumerate(runs):
                    test = np.flatnonzero(part[:, job["part"]] == TEST)
                    score = pa.array(chance(at[test, k]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(test), k, np.int32)), batch.column("key").take(pa.array(test)), batch.column("y").take(pa.array(test)), score], ["run", "key", "label", "score"])

        return self.rows.mapInArrow(work, SCORES)


def _prepared(d: DataFrame, key: str, label: str, features: list[str], parts: list[Column], block_rows: int) -> tuple[DataFrame, list[list[float]], bool]:
    edges = edges_of(d.where(F.col(label).isNotNull()), features)
    rows = X.kept(coded(d, key, label, features, parts, edges))
    n = rows.count()
    return rows if n <= block_rows else rows.repartition(-(-n // min(block_rows, TASK_ROWS))), edges, n <= block_rows


def scores(d: DataFrame, key: str, label: str, features: list[str], runs: list[dict], parts: list[Column], block_rows: int = BLOCK_ROWS, settled: int = SETTLED_ROUNDS) -> DataFrame:
    """``(run, key, label, score)`` of all TEST rows of all ``runs``, each fitted on all its TRAIN rows.

    A run is ``{"columns", "part", "params"}``: numbers of its features, the number of its split in ``parts`` (codes of TRAIN, TEST, UNUSED),
    and ``rounds, rate, leaves, least, l2``. Rows without a label are left out.
    """
    rows, _, one = _prepared(d, key, label, features, parts, block_rows)
    if one:
        return _in_one_block(rows, runs, len(features), len(parts), models=False)
    over = _Over(rows, runs, len(features), len(parts), block_rows)
    over.fit(settled)
    return over.scores()


def model(d: DataFrame, key: str, label: str, features: list[str], params: dict, block_rows: int = BLOCK_ROWS, settled: int = SETTLED_ROUNDS) -> dict:
    """``{"start", "edges", "trees"}``: one model of all rows of ``d`` with a label, as plain values."""
    rows, edges, one = _prepared(d, key, label, features, [F.lit(TRAIN)], block_rows)
    runs = [{"columns": list(range(len(features))), "part": 0, "params": params}]
    if one:
        found = _in_one_block(rows, runs, len(features), 1, models=True).collect()  # one model
        start, trees = (found[0].start, json.loads(found[0].trees)) if found else (start_of(0.5), [])
    else:
        over = _Over(rows, runs, len(features), 1, block_rows)
        over.fit(settled)
        start, trees = over.starts[0], over.trees[0]
    return {"start": start, "edges": edges, "trees": trees}
