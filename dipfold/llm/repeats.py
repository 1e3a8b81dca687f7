"""Operator 6. Passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept only at content-selected positions: the minimisers of SEED-word hashes over windows chosen so that any MIN_MATCH words in
a row hold one whole window. Equal passages select equal positions, so every match of MIN_MATCH words holds a
minimiser that both copies keep. Of these suffixes, those whose seed occurs once are dropped by a count. The rest carry the hashes
of the words that follow and precede them, are sorted by what follows (the sparse suffix array) and, in a second array, by what
precedes, and are compared with their neighbours: the common prefix of the two neighbours gives the longest match to the
right (to the left) with any other suffix. A neighbour that attains both is extended left and right to one
span. Where the longest match to the right and the longest to the left belong to different partners and could
still make a passage together, the suffix is undecided, and all windows of MIN_MATCH words around it are counted exactly.

Both arrays are sorted by ranges over the whole cluster; the order has a unique tie-break, so no seed, however common, lands in one
task, and only the first and last suffix of each range are compared across ranges. Equal texts are sorted out first by their
digests and take part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipfold.llm.common import cut, map_texts, n_words

MIN_MATCH = 50
SEED = 8
#: Bytes by which a word is told from others in a suffix.
WIDTH = 4
#: Salt of the word hashes.
SALT = 11

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each ``[^\\x20\\x09-\\x0D]+`` word, letter case kept."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, SALT) for w in (text or "").encode().split()], np.uint64)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, size, step, rest = np.zeros(n, np.uint64), 0, h, 1, _MIX, width
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                out = out * step + block[done : done + n]
                done += size
            rest >>= 1
            if rest:
                block = block[: len(block) - size] * step + block[size:]
                step, size = step * step, size * 2
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def minimisers(h: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the minimisers of all windows of ``least`` words, and their seed hashes.

    Of equal smallest hashes in a window the last is taken; in both copies of a passage alike.
    """
    s = rolling(h, seed)
    span = least - seed + 1
    if len(s) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(s, span)
    at = np.empty(len(windows), np.int64)
    for k in range(0, len(windows), 1 << 15):
        part = windows[k : k + (1 << 15), ::-1]
        at[k : k + (1 << 15)] = np.arange(k, k + len(part)) + span - 1 - part.argmin(axis=1)
    at = np.unique(at)
    return at, s[at]


def _sides(h: np.ndarray, at: np.ndarray, least: int) -> tuple[list[bytes], list[bytes]]:
    """For each position the words from it on, and those before it backwards, as bytes that sort like their hashes.

    Each side holds at most ``least`` words, four bytes a word; what a text lacks is simply not there.
    """
    small = (h >> np.uint64(32)).astype(">u4")
    back = small[::-1].copy()
    n, right, left = len(h), small.tobytes(), back.tobytes()
    return [right[4 * p : 4 * min(p + least, n)] for p in at.tolist()], [left[4 * (n - p) : 4 * min(n - p + least, n)] for p in at.tolist()]


def common(a: bytes, b: bytes) -> int:
    """How many leading words two sides share."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    x = np.frombuffer(a, ">u4", n) != np.frombuffer(b, ">u4", n)
    return int(x.argmax())


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``(key, copies, head)`` per different text with a word: 128-bit digest, number of rows, and the row that stands for it."""
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id"))["doc_id"]
    return docs.groupBy("key").agg(F.count("*").alias("copies"), head.alias("head"))


def _neighbours(sorted_by: str, other: str, least: int):
    """Compare each suffix of a sorted range with the one before it; carries the first and last of the range out as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        first = True
        for batch in batches:
            keys, at = batch.column("key").to_pylist(), batch.column("at").to_pylist()
            own, far = batch.column(sorted_by).to_pylist(), batch.column(other).to_pylist()
            rows: list[tuple] = []
            for row in zip(keys, at, own, far, strict=True):
                if first:
                    rows.append((row[0], row[1], row[2], row[3], 0, 0, True))
                    first = False
                else:
                    x, y = common(last[2], row[2]), 0
                    if x:
                        y = common(last[3], row[3])
                        rows.append((last[0], last[1], None, None, x, y, False))
                        rows.append((row[0], row[1], None, None, x, y, False))
                last = row
            yield _edges(rows)
        if last is not None:
            yield _edges([(last[0], last[1], last[2], last[3], 0, 0, True)])

    def _edges(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
        names = ("key", "at", "own", "far", "x", "y", "edge")
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(names))

    return run


def _array(suffixes: DataFrame, sorted_by: str, other: str, least: int) -> DataFrame:
    """``(key, at, x, y)``: for each suffix and each of its neighbours in one array, the words shared on the sorted and on the other side."""
    sort = [F.col(sorted_by), F.col("key"), F.col("at")]
    dealt = suffixes.repartitionByRange(*sort).sortWithinPartitions(*sort)
    schema = "key binary, at long, own binary, far binary, x long, y long, edge boolean"
    compared = cut(dealt.mapInArrow(_neighbours(sorted_by, other, least), schema), f"array-{sorted_by}")
    # two rows for each range are left to compare across ranges: their number is that of the partitions
    edges = compared.where("edge").dropDuplicates(["key", "at"]).coalesce(1).sortWithinPartitions("own", "key", "at")
    edges = edges.withColumnRenamed("own", sorted_by).withColumnRenamed("far", other).select("key", "at", sorted_by, other)
    met = edges.mapInArrow(_neighbours(sorted_by, other, least), schema)
    return compared.where("NOT edge").select("key", "at", "x", "y").union(met.where("NOT edge").select("key", "at", "x", "y"))


def spans(docs: DataFrame, keys: DataFrame, texts: DataFrame, least: int = MIN_MATCH, seed: int = SEED) -> DataFrame:
    """The repeated spans of the different texts of ``docs`` (columns ``key, doc_id, text``).

    ``keys`` holds ``key, doc_id`` of the same rows, ``texts`` is what :func:`distinct_texts` gives for them.

    Spans are rows ``(key, start, stop)`` in words, each part of a run of at least ``least`` words that occurs in another text or
    at another place of its own.
    """
    # a text of fewer characters has too few words
    docs = docs.where(F.length("text") >= 2 * least - 1)

    def select(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ats, seeds = [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            at, s = minimisers(word_hashes(text), least, seed)
            keys += [key] * len(at)
            ats.append(at)
            seeds.append(s)
        at, s = np.concatenate([*ats, np.zeros(0, np.int64)]), np.concatenate([*seeds, np.zeros(0, np.uint64)])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(at), pa.array(s.view(np.int64))], ["key", "at", "seed"])

    found = cut(map_texts(docs.select("key", "text"), select, "key binary, at long, seed long"), "minimisers")
    # a text is read once for each of its copies here, and equal rows are one suffix: a seed repeats if it has two different places;
    # written, so that the join shuffles both sides itself and can split a seed that very many suffixes have
    place = F.xxhash64("key", "at")
    shared = cut(found.groupBy("seed").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("seed"), "shared")
    wanted = found.join(shared, "seed", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("ats"))

    def carry(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        keys, places, rights, lefts = [], [], [], []
        for key, text, ats in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "ats")), strict=True):
            right, left = _sides(word_hashes(text), np.array(ats, np.int64), least)
            keys += [key] * len(ats)
            places += ats
            rights += right
            lefts += left
        seeds = pa.array(np.array([xxhash.xxh64_intdigest(r[: WIDTH * seed]) for r in rights], np.uint64).view(np.int64))
        cols = [pa.array(keys, pa.binary()), pa.array(places, pa.int64()), pa.array(rights, pa.binary()), pa.array(lefts, pa.binary()), seeds]
        return pa.RecordBatch.from_arrays(cols, ["key", "at", "after", "before", "seed"])

    # texts meet their places by digest and id: one row of each text, and copies of one text are not one key
    of_head = wanted.join(texts.select("key", F.col("head").alias("doc_id")), "key")
    heads = docs.join(of_head, (docs["key"] == of_head["key"]) & docs["doc_id"].eqNullSafe(of_head["doc_id"])).select(docs["key"], "text", "ats")
    carried = map_texts(heads, carry, "key binary, at long, after binary, before binary, seed long")
    twice = keys.groupBy("key", "doc_id").agg(F.count("*").alias("n")).where("n > 1").join(texts, "key").where("doc_id <=> head")
    if not twice.isEmpty():  # a row that stands for its text is itself repeated
        carried = carried.dropDuplicates(["key", "at"])
    suffixes = cut(carried, "suffixes")
    sides = suffixes.drop("seed")
    right = _array(sides, "after", "before", least).select("key", "at", F.col("x").alias("r"), F.col("y").alias("l"))
    left = _array(sides, "before", "after", least).select("key", "at", F.col("y").alias("r"), F.col("x").alias("l"))
    best = F.max(F.when(F.col("r") + F.col("l") >= least, F.struct((F.col("r") + F.col("l")).alias("n"), "r", "l")))
    per = cut(right.union(left).groupBy("key", "at").agg(F.max("r").alias("far"), F.max("l").alias("back"), best.alias("best")).where(F.col("far") + F.col("back") >= least), "matches")
    known = per.where("best IS NOT NULL").select("key", (F.col("at") - F.col("best.l")).alias("start"), (F.col("at") + F.col("best.r")).alias("stop"))
    known = cut(merged(known), "known")
    # undecided and not within what is known to repeat anyway
    reach = F.exists("spans", lambda s: (s["start"] <= F.col("at") - F.col("back")) & (s["stop"] >= F.col("at") + F.col("far")))
    unsure = per.where("best IS NULL OR best.r <> far OR best.l <> back").join(known, "key", "left").where(~F.coalesce(reach, F.lit(False)))
    unsure = cut(unsure.select("key", "at"), "unsure")
    # a window around an undecided suffix can only occur around suffixes with the same seed: only these bring their words
    small = suffixes.select("key", "at", "seed")
    asked = cut(small.join(unsure, ["key", "at"], "left_semi").select("seed").distinct(), "seeds")
    near = small.join(asked, "seed", "left_semi").select("key", "at").join(per.select("key", "at", "far", "back"), ["key", "at"])
    near = near.join(unsure.withColumn("open", F.lit(True)), ["key", "at"], "left")
    seeds = cut(suffixes.drop("seed").join(cut(near, "near"), ["key", "at"]), "asked")
    open_ = seeds.where("open")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, starts, hashes = [], [], []
        for key, at, far, back, after, before in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "far", "back", "after", "before")), strict=True):
            ahead = np.frombuffer(after, ">u4").astype(np.uint64)[:far]
            behind = np.frombuffer(before, ">u4").astype(np.uint64)[:back][::-1]
            h = rolling(np.concatenate([behind, ahead]) * _MIX, least)
            keys += [key] * len(h)
            starts.append(np.arange(len(h)) + at - len(behind))
            hashes.append(h)
        at, h = np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*hashes, np.zeros(0, np.uint64)])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(at), pa.array(h.view(np.int64))], ["key", "start", "window"])

    some = cut(_windows(open_.select("key", "at", "far", "back", "after", "before"), windows), "windows")
    alike = seeds.where("open IS NULL")
    others = _windows(alike.select("key", "at", "far", "back", "after", "before"), windows)
    others = others.join(cut(some.select("window").distinct(), "asked"), "window", "left_semi")
    twice = some.unionByName(others).dropDuplicates(["key", "start"]).groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    settled = some.join(cut(twice, "twice"), "window", "left_semi").select("key", "start", (F.col("start") + least).alias("stop"))
    flat = known.select("key", F.explode("spans").alias("s")).select("key", "s.start", "s.stop")
    return flat.unionByName(settled)


def _windows(suffixes: DataFrame, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                yield work(batch.slice(k, 2048))

    return suffixes.mapInArrow(run, "key binary, start long, window long")


def text_key():
    """128 bits of a digest of the text; null has a key of its own."""
    return F.coalesce(F.unhex(F.substring(F.sha2(F.col("text"), 256), 1, 32)), F.lit(b"\0"))


def merged(found: DataFrame) -> DataFrame:
    """``(key, spans)`` with overlapping and touching spans united, as sorted ``array<struct<start, stop>>``."""
    order = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = found.distinct().withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    d = d.withColumn("part", F.sum("new").over(order)).groupBy("key", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return d.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def judge(docs: DataFrame, least: int = MIN_MATCH, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, copies, repeated_words, n_spans, spans, repeated``.

    * ``spans``: like ``12-80 300-371``, half-open in words (``[^\\x20\\x09-\\x0D]+``), united; each word in them lies in a run of at least
      ``least`` words that occurs elsewhere: in another text, elsewhere in the same text, or in an equal copy of the whole text.
    * ``copies``: rows with exactly this text. A text of at least ``least`` words with several copies is one whole span.
    * Null and short texts have no spans. Null ids and repeated rows are kept, each by itself; texts of any length are read whole;
      other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(text_key().alias("key"), F.col("doc_id").cast("long"), "text")
    keys = cut(docs.select("key", "doc_id", n_words(F.col("text")).alias("n_words")), "keys")
    texts = cut(distinct_texts(keys), "texts")
    per = cut(texts.select("key", "copies").join(merged(spans(docs, keys, texts, least, seed)), "key", "left"), "spans")
    d = keys.join(per, "key")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= least)
    own = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))).otherwise(
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    )
    d = d.withColumn("spans", own)
    covered_words = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return d.select(
        "doc_id", "n_words", "copies", covered_words.alias("repeated_words"), F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), " ").alias("spans"),
        (F.size("spans") > 0).alias("repeated"),
    )
