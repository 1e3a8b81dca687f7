"""Operator 10. Benchmark decontamination by greedy string tiling.

Seeds are runs of MIN_MATCH words of the test items. The share of an item's words that lie in seeds it shares with a text bounds from
above what tiles can cover. A text and an item are a candidate pair if the text has one of the item's rarest seeds (of the others
alone it cannot have enough), and pairs whose bound is below the threshold are dropped without loss. For the others, greedy string
tiling marks, again and again, the longest matches of unmarked
words that do not overlap, found by running Karp-Rabin: a rolling hash over the unmarked stretches of the item, looked up for those
of the text, at lengths that are adapted to what is found. The share of the item's words under tiles is its coverage; a passage
whose parts were put in another order is still covered.

Words are compared in lower case without punctuation. The seeds of the benchmark are broadcast if the benchmark has at
most BROADCAST_WORDS words (checked by a count), otherwise texts and items meet by a join on hashed seeds.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dipfold.llm.common import cut, fresh, map_texts, share

MIN_MATCH = 5
THRESHOLD = 0.6
BROADCAST_WORDS = 300_000
#: Bounds are compared with a little less than the threshold, so that rounding loses no pair.
SLACK = 1e-9
_WORD = re.compile(r"\w+")

SCHEMA = "doc_id long, n_items long, item_id long, coverage double, tiles long, contaminated boolean"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def tile(item: list, text: list, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(position in item, position in text, length)``, longest first, ties by position.

    Running Karp-Rabin with the search length halved when nothing as long is left and set to what was found when more is. Of all unmarked matches
    the longest one is always the next tile: parts of a match that is cut go back into the queue, and the search length falls only when the
    queue is empty.
    """
    ids: dict = {}
    a = np.array([ids.setdefault(w, len(ids) + 1) for w in item], np.uint64)
    b = np.array([ids.setdefault(w, len(ids) + 1) for w in text], np.uint64)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    tiles: list[tuple[int, int, int]] = []
    s = max(least, min(len(a), len(b)) // 2)
    while True:
        matches = _matches(a, b, free_a, free_b, s)
        longest = max((m[2] for m in matches), default=0)
        if longest >= 2 * s and s < longest:
            s = longest  # start again with the longer matches alone
            continue
        heap = [(-n, i, j) for i, j, n in matches]
        heapify(heap)
        while heap:
            n, i, j = heappop(heap)
            free = free_a[i : i - n] & free_b[j : j - n]
            if free.all():
                tiles.append((i, j, -n))
                free_a[i : i - n] = False
                free_b[j : j - n] = False
                continue
            # what is left of a match that a longer tile has cut waits for its turn by the length it has now
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if stop - start >= s:
                    heappush(heap, (start - stop, i + start, j + start))
        if s == least and not matches:
            return tiles
        s = max(least, s // 2)


def _hashes(x: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of unmarked windows of s words, and their Karp-Rabin hashes (by doubling, as s is fixed per round)."""
    n = len(x) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marked = np.concatenate([[0], np.cumsum(~free)])
    base = np.uint64(0x9E3779B97F4A7C15)
    out, done, block = np.zeros(n, np.uint64), 0, x * np.uint64(0xBF58476D1CE4E5B9)
    width, step = 1, base
    with np.errstate(over="ignore"):
        rest = s
        while rest:
            if rest & 1:
                out = out * step + block[done : done + n]
                done += width
            rest >>= 1
            if rest:
                block = block[: len(block) - width] * step + block[width:]
                step = step * step
                width *= 2
    at = np.flatnonzero(marked[s:] == marked[:n])
    return at, out[at]


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Matches of at least s unmarked words that cannot be extended to the left, each at its full length."""
    at_a, hash_a = _hashes(a, free_a, s)
    at_b, hash_b = _hashes(b, free_b, s)
    own = defaultdict(list)
    for i, h in zip(at_a.tolist(), hash_a.tolist(), strict=True):
        own[h].append(i)
    keep = np.isin(hash_b, hash_a)
    out = []
    for j, h in zip(at_b[keep].tolist(), hash_b[keep].tolist(), strict=True):
        for i in own[h]:
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n >= s:
                out.append((i, j, n))
    return out


def coverage(seeds: list[bytes | int], wanted: set, least: int) -> int:
    """How many words of an item lie in those of its ``seeds``, given in order, that are ``wanted``."""
    n, end = 0, 0
    for i, seed in enumerate(seeds):
        if seed in wanted:
            n += i + least - max(i, end)
            end = i + least
    return n


def probes(seeds: list[bytes | int], held: list[int], least: int, threshold: float) -> set:
    """The seeds of one item by which texts are searched: its rarest (``held``: the number of items with each seed).

    A text that has none of them can share too few of the others: those cover less than ``threshold`` of the item's words. So nothing is
    lost, and a phrase that very many items share is searched for only where an item has hardly anything else.
    """
    size = len(seeds) + least - 1
    order = sorted(dict(zip(seeds, held, strict=True)).items(), key=lambda x: (-x[1], x[0]))
    common: set = set()
    low, high = 0, len(order)
    while low < high:  # as many of the commonest as may be left out; coverage grows with their number
        k = (low + high + 1) // 2
        common = {x for x, _ in order[:k]}
        low, high = (k, high) if coverage(seeds, common, least) < threshold * size - SLACK else (low, k - 1)
    return {x for x, _ in order[low:]}


class Seeds:
    """The different items' words, their seeds, and which items the rare seeds belong to."""

    def __init__(self, items: list[tuple[list[int | None], list[str]]], least: int = MIN_MATCH, threshold: float = THRESHOLD):
        self.items, self.least, self.threshold = items, least, threshold
        self.vocabulary: dict[str, int] = {}
        self.seeds: list[list[bytes]] = []
        for _, words in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
            self.seeds.append([ids[i : i + least].tobytes() for i in range(len(ids) - least + 1)])
        held = Counter(x for own in self.seeds for x in set(own))
        self.known = set(held)
        self.probes: dict[bytes, list[int]] = defaultdict(list)
        for k, own in enumerate(self.seeds):
            for x in probes(own, [held[x] for x in own], least, threshold):
                self.probes[x].append(k)

    def candidates(self, words: list[str]) -> list[int]:
        """The items of which the seeds that the text shares cover enough."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        n = len(ids) - self.least + 1
        if n <= 0:
            return []
        raw, width = ids.tobytes(), 4 * self.least
        shared = {raw[4 * j : 4 * j + width] for j in np.flatnonzero(unknown[self.least :] == unknown[:n]).tolist()} & self.known
        found = {k for x in shared for k in self.probes.get(x, ())}
        return sorted(k for k in found if coverage(self.seeds[k], shared, self.least) >= self.threshold * len(self.items[k][1]) - SLACK)

    def judge(self, text: str | None) -> list[tuple[int, float, int]]:
        """``(item number, coverage, tiles)`` of all different items that the text contaminates."""
        words = words_of(text)
        out = []
        for k in self.candidates(words):
            item = self.items[k][1]
            tiles = tile(item, words, self.least)
            part = sum(n for _, _, n in tiles) / len(item)
            if part >= self.threshold:
                out.append((k, part, len(tiles)))
        return out

    def best(self, text: str | None) -> tuple[int, int | None, float, int]:
        found = self.judge(text)
        return _best([(i, c, n) for k, c, n in found for i in self.items[k][0]])


def _best(found: list[tuple[int | None, float, int]]) -> tuple[int, int | None, float, int]:
    """Number of items, and the one that is covered most (ties: the smallest id, null last)."""
    if not found:
        return 0, None, 0.0, 0
    item, coverage, tiles = min(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))
    return len(found), item, coverage, tiles


def _items(benchmark: DataFrame) -> DataFrame:
    """The items, each once: ``item_id, text``."""
    return benchmark.select(F.col("item_id").cast("long"), "text").distinct()


def small_enough(benchmark: DataFrame) -> bool:
    """Whether the benchmark may be broadcast: its words are counted, not assumed."""
    n = benchmark.agg(F.sum(F.length("text") / 2 + 1).alias("n"), F.count("*").alias("rows")).first()
    return (n.n or 0) + n.rows <= BROADCAST_WORDS


def _seeds(benchmark: DataFrame, least: int) -> list[tuple[list[int | None], list[str]]]:
    """Ids and words of the different word sequences; equal ones are tiled once."""
    same: dict[tuple[str, ...], list[int | None]] = defaultdict(list)
    for r in _items(benchmark).collect():  # at most BROADCAST_WORDS words
        words = tuple(words_of(r.text))
        if len(words) >= least:
            same[words].append(r.item_id)
    return [(ids, list(words)) for words, ids in sorted(same.items())]


def judge(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = MIN_MATCH, broadcast: bool | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_items, item_id, coverage, tiles, contaminated``.

    * ``n_items``: test items of which tiles of at least ``least`` words cover at least ``threshold``; ``item_id``, ``coverage`` and
      ``tiles`` belong to the one covered most (ties: the smallest id), null and 0 without any. Equal rows of ``benchmark`` are one item.
    * Items of fewer than ``least`` words cannot be told from chance and match nothing. A null text contains nothing. Null ids and
      repeated rows are judged each by itself; texts of any length are read whole; other columns are ignored; an empty table gives an empty
      result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if small_enough(benchmark) if broadcast is None else broadcast:
        get = share(docs.sparkSession, Seeds, {"items": _seeds(benchmark, least), "least": least, "threshold": threshold})

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            seeds = get()
            found = [seeds.best(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *cols, pa.array([f[0] > 0 for f in found], pa.bool_())],
                ["doc_id", "n_items", "item_id", "coverage", "tiles", "contaminated"],
            )

        return map_texts(rows, work, SCHEMA)
    return _joined(rows, benchmark, threshold, least).drop("row")


def _row(doc_id: Column, text: Column) -> Column:
    """The key of a row: rows without an id, and rows that share one, are told apart by their texts."""
    return F.xxhash64(doc_id.cast("long"), text)


def _seeds_of(texts: DataFrame, key: str, least: int, once: bool) -> DataFrame:
    """``(key, at, seed)``: hashed seeds of each text in order; with ``once`` each seed of a text counts once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        keys, places, seeds = [], [], []
        for k, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            own = [xxhash.xxh64_intdigest("\n".join(words[i : i + least])) for i in range(len(words) - least + 1)]
            own = list(dict.fromkeys(own)) if once else own
            keys += [k] * len(own)
            places += range(len(own))
            seeds += own
        at = np.array(seeds, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(at)], [key, "at", "seed"])

    return map_texts(texts.select(key, "text"), work, f"{key} long, at long, seed long")


def _probes_of(items: DataFrame, least: int, threshold: float) -> DataFrame:
    """``(item, seed)``: the rare seeds by which each item is searched for. A group is one item's seeds."""
    own = cut(_seeds_of(items, "item", least, once=False), "item-seeds")
    held = own.groupBy("seed").agg(F.count_distinct("item").alias("held"))
    lists = own.join(held, "seed").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "seed", "held"))).alias("seeds"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, seeds = [], []
            for item, own in zip(batch.column("item").to_pylist(), batch.column("seeds").to_pylist(), strict=True):
                rare = probes([x["seed"] for x in own], [x["held"] for x in own], least, threshold)
                items += [item] * len(rare)
                seeds += rare
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(seeds, pa.int64())], ["item", "seed"])

    return lists.mapInArrow(work, "item long, seed long")


def _joined(rows: DataFrame, benchmark: DataFrame, threshold: float, least: int) -> DataFrame:
    """The way for a benchmark of any size: texts and items meet by a join on hashed rare seeds. Gives ``row``, the key of each row, too."""
    number = cut(rows.withColumn("row", _row(F.col("doc_id"), F.col("text"))), "texts")
    # items of one text are tiled once
    names = cut(_items(benchmark).withColumn("item", F.xxhash64("text")), "names")
    items = cut(names.select("item", "text").dropDuplicates(["item"]), "items")
    texts = number.dropDuplicates(["row"]).select("row", "text")
    pairs = _seeds_of(texts, "row", least, once=True).join(_probes_of(items, least, threshold), "seed").select("row", "item").distinct()
    pairs = pairs.join(items.select("item", F.col("text").alias("item_text")), "item").join(texts, "row")

    def tiled(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, item in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist(), strict=True):
            out.append(next(iter(Seeds([([None], words_of(item))], least, threshold).judge(text)), (0, 0.0, 0)))
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("item"), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.int64())],
            ["row", "item", "coverage", "tiles"],
        )

    found = map_texts(pairs.select("row", "item", "text", "item_text"), tiled, "row long, item long, coverage double, tiles long")
    found = found.where((F.col("tiles") > 0) & (F.col("coverage") >= threshold)).join(names.select("item", "item_id"), "item")
    order = F.struct((-F.col("coverage")).alias("c"), F.col("item_id").isNull().alias("no"), "item_id", "tiles")
    best = found.groupBy("row").agg(F.count("*").alias("n"), F.min(order).alias("best"))
    out = number.drop("text").join(best, "row", "left")
    return out.select(
        "row", "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.col("best.item_id"), F.coalesce(-F.col("best.c"), F.lit(0.0)).alias("coverage"),
        F.coalesce("best.tiles", F.lit(0)).cast("long").alias("tiles"), F.col("n").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = MIN_MATCH, broadcast: bool | None = None) -> DataFrame:
    """The rows of ``docs`` that contaminate no item, unchanged; the same rows whether the benchmark is broadcast or joined.

    Each row is judged by its own text, whatever its id: rows without an id, and rows that share one, stay or go each by itself. Null and
    short texts stay; repeated rows stay or go together; texts of any length are read whole; columns of any name and type are kept; an
    empty table gives an empty result, an empty benchmark keeps all.
    """
    if small_enough(benchmark) if broadcast is None else broadcast:
        get = share(docs.sparkSession, Seeds, {"items": _seeds(benchmark, least), "least": least, "threshold": threshold})

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([not get().judge(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        return map_texts(docs, work, T.StructType.fromJson(docs.schema.jsonValue()))
    (bad,) = fresh(docs, "bad_row")
    found = _joined(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, threshold, least).where("contaminated")
    return docs.join(found.select(F.col("row").alias(bad)).distinct(), _row(docs["doc_id"], docs["text"]) == F.col(bad), "left_anti")
