"""Operator 12. Importance resampling of documents towards a target distribution.

Texts become bags of hashed word and word-pair features. One pass writes each document's buckets as a small array, so texts are taken apart once. Counts
of all documents and of all target texts, BUCKETS numbers each, give the gain of each bucket; a document's weight is the mean gain over its
array. A weight plus a keyed Gumbel noise is its score, and the highest scores are a draw without replacement in proportion to the
exponentials of the weights.

The draw is exact and sorts nothing as a whole: scores are integers of a bounded range, so a histogram of them is small whatever the corpus. Its
sums from the top give each score the number of rows above it, the rank offset; the score in which the wanted number is reached is the cutoff. Only
rows of one surviving score are numbered together, by ``doc_id``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipfold.llm.common import cut, map_texts
from dipfold.llm.sql import FOLD
from dipfold.llm.sql import crc32 as crc32_sql

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Scores whose counts are summed together before the blocks are.
BLOCK = 256
#: A-Z become a-z, bytes of words stay, and all others are blanks. Bytes beyond ASCII belong to words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def buckets_of(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each word and each pair of neighbours."""
    words = (text or "").encode().translate(WORD_BYTES).split()
    single = [crc32(w) for w in words]
    pairs = [crc32(w, crc32(b" ", c)) for c, w in zip(single, words[1:], strict=False)]
    return len(words), (np.array(single + pairs, np.uint32) % buckets).astype(np.uint16)


def featured(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, buckets)`` for each row ``(doc_id, text)``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [buckets_of(t, buckets) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())],
            ["doc_id", "n_words", "n_features", "buckets"],
        )

    return map_texts(rows.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_words long, n_features long, buckets binary")


def counts(marked: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows lie in each bucket: summed in each task first, then ``buckets`` numbers in all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets"):
                total += np.bincount(np.frombuffer(b.as_buffer(), np.uint16), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in marked.select("buckets").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the smoothed shares of target and corpus, in whole numbers."""
    n, m = float(own.sum() + len(own)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * n / ((s + 1.0) * m))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(marked: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the floored mean gain of a row's features, 0 without any."""
    sent = marked.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(b.as_buffer(), np.uint16) for b in batch.column("buckets")]
            weight = [int(sent.value[b].sum()) // len(b) if len(b) else 0 for b in held]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return marked.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a standard Gumbel number made from the id, in whole numbers; ids alike have it alike, null is like an empty id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def above(rows: DataFrame) -> DataFrame:
    """``(score, above)`` for each score of ``rows``: how many rows have a higher one. Sums go up in two steps, within blocks of scores and over the blocks."""
    higher = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    per = rows.groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK))
    blocks = per.groupBy("block").agg(F.sum("n").alias("own"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("own").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(*higher)), zero)).drop("own")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(*higher)), zero)
    return per.withColumn("inside", inside).join(blocks, "block").select("score", (F.col("base") + F.col("inside")).alias("above"))


def drawn(rows: DataFrame, wanted: int) -> DataFrame:
    """``rows`` (``doc_id, n_features, weight, score``) with their ``rank`` from the highest score down, NULL beyond ``wanted``.

    Equal rows are counted first and given their ranks afterwards, so no number of them is ordered together.
    """
    dealt = rows.join(cut(above(rows), "places"), "score")
    cols = ["doc_id", "n_features", "weight", "score"]
    same = dealt.where(F.col("above") < wanted).groupBy(*cols, "above").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("above") + F.coalesce(F.sum("copies").over(order), F.lit(0))
    rank = F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("copies")))
    out = same.withColumn("first", first).select(*cols, rank.alias("rank")).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return out.union(dealt.where(F.col("above") >= wanted).select(*cols, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_features, weight, score, rank``.

    * Of the rows with at least ``least_words`` words, ``percent`` in a hundred are drawn (rounded down), the highest scores first; ``rank`` is NULL for
      all others. Ties go to the smaller ``doc_id``, a null one last; rows with the same id share their noise, so repeated rows tie and
      get ranks one after another.
    * A null or empty text has no feature and weight 0. Texts of any length are read whole. An empty ``target`` counts nothing, an empty ``docs`` gives an
      empty result; columns other than ``doc_id`` and ``text`` are ignored.
    """
    marked = cut(featured(docs, buckets), "features")
    wanted_texts = featured(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    rows = weighted(marked, gains(counts(marked, buckets), counts(wanted_texts, buckets)))
    rows = cut(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    enough = F.col("n_words") >= least_words
    cols = ["doc_id", "n_features", "weight", "score"]
    fit = rows.where(enough).select(*cols)
    return drawn(fit, percent * fit.count() // 100).union(rows.where(~enough).select(*cols, F.lit(None).cast("long").alias("rank")))


_FEATURES = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BAG = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
ORACLE = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_FEATURES.format(t=FOLD.format(text="coalesce(text, '')"))} AS w FROM documents),
q AS (SELECT {_FEATURES.format(t=FOLD.format(text="coalesce(text, '')"))} AS w FROM benchmark),
f AS (SELECT r, {_BAG} AS f FROM d), g AS (SELECT {_BAG} AS f FROM q),
b AS (SELECT f, {crc32_sql("f")} % {BUCKETS} AS b FROM (SELECT f FROM f UNION SELECT f FROM g)),
own AS (SELECT b, count(*) AS s FROM f JOIN b USING (f) GROUP BY b), want AS (SELECT b, count(*) AS t FROM g JOIN b USING (f) GROUP BY b),
gain AS (SELECT x.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS b) x LEFT JOIN own ON own.b = x.b LEFT JOIN want ON want.b = x.b),
m AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN b USING (f) JOIN gain ON gain.b = b.b GROUP BY r),
e AS (SELECT doc_id, r, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END END AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN m USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, {PERCENT} * count(*) OVER () // 100 AS wanted FROM e WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= wanted THEN rank END AS rank FROM e LEFT JOIN k USING (r)"""
