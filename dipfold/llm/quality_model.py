"""Operator 1. Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: byte n-grams of one to four bytes, and the unigrams of a few structural
tokens (how much of the text repeats itself by three-word windows and by lines, how many words are written in capitals, in
coarse steps), all hashed to one space. Indicators are scaled by the log ratio of the class counts, each text is brought to
unit length, and a linear hinge-loss model is fitted by dual coordinate descent. Its weights are blended with their
mean as the method has it, and a logistic fit on rows left out of the descent turns margins into scores.

The model is fitted on a bounded sample of labelled rows (TRAIN_ROWS, a parameter); every whole text is scored where it
is read: no shuffle, memory of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfold.llm.common import map_texts, share
from dipfold.llm.labelled import logistic, remainder, sigmoid, training_rows

BITS = 18
SPACE = 1 << BITS
TRAIN_ROWS = 5000
PARTS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Strength of the hinge loss, smoothing of the counts, share of the fitted weights in the blend, passes of the descent.
C, SMOOTH, BLEND, PASSES = 4.0, 1.0, 0.75, 30
SEED = 7


def _tokens(raw: bytes) -> list[bytes]:
    words = raw.split()
    if not words:
        return [b"none"]
    step = lambda share: int(10 * share + 1e-9)
    windows = max(1, len(words) - 2)
    again = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / windows if len(words) > 2 else 0
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    same = 1 - len(set(lines)) / max(1, len(lines))
    capitals = sum(map(bytes.isupper, words)) / len(words)
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    return [b"twice%d" % step(twice), b"again%d" % step(again), b"lines%d" % step(same), b"capitals%d" % step(capitals)]


def features(text: str | None) -> np.ndarray:
    """The sorted distinct feature numbers of one text."""
    raw = (text or "").encode()
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    code, parts = a, []
    for n in range(1, 5):
        if n > 1:
            code = (code[:-1] << np.uint64(8)) | a[n - 1 :]
        parts.append(np.unique(((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)) if len(code) else code)
    own = [hash_token(t) for t in _tokens(raw)]
    return np.unique(np.concatenate([*parts, np.array(own, np.uint64)])).astype(np.int64)


def hash_token(token: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(token, SEED) >> (64 - BITS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def margin(self, f: np.ndarray) -> float:
        return float(self.weights[0][f].sum() / max(np.sqrt(self.weights[1][f].sum()), 1e-12) + self.bias)

    def score(self, texts: list[str | None]) -> np.ndarray:
        m = np.array([self.margin(features(t)) for t in texts], float)
        return sigmoid(self.slope * m + self.intercept)


def packed(f: np.ndarray) -> bytes:
    """Feature numbers as bytes: four for each, or one bit for each of the space where that is less. At most SPACE / 8 bytes for any text."""
    if 4 * len(f) <= SPACE // 8:
        return f.astype("<i4").tobytes()
    bits = np.zeros(SPACE, bool)
    bits[f] = True
    return np.packbits(bits).tobytes() + b"b"


def unpacked(raw: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, len(raw) - 1))) if len(raw) % 4 else np.frombuffer(raw, "<i4").astype(np.int64)


def descend(rows: list[bytes], y: np.ndarray, ratio: np.ndarray, c: float = C, passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the weights of the features and of the bias.

    A row is the indicators in ``rows`` times ``ratio``, brought to unit length, and a one for the bias. Rows stay packed and are scaled
    as they are used: the weights are ``ratio`` times ``q``, and a step adds the same number to ``q`` at all of a row's features.
    """
    q, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    square = ratio * ratio
    norm = np.array([max(np.sqrt(square[unpacked(r)].sum()), 1e-12) for r in rows])
    length = np.array([square[unpacked(r)].sum() for r in rows]) / norm**2 + 1
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(rows)):
            f = unpacked(rows[i])
            g = y[i] * (float(square[f] @ q[f]) / norm[i] + bias) - 1
            pg = min(g, 0) if alpha[i] <= 0 else max(g, 0) if alpha[i] >= c else g
            most = max(most, abs(pg))
            if pg:
                old = alpha[i]
                alpha[i] = min(max(old - g / length[i], 0), c)
                step = (alpha[i] - old) * y[i]
                q[f] += step / norm[i]
                bias += step
        if most < 1e-3:
            break
    return ratio * q, bias


def fit(found: list[bytes], labels: np.ndarray) -> Model:
    """A model from packed feature numbers and 0/1 labels. With one class only, scores are that class's smoothed share."""
    n = len(found)
    labels = np.asarray(labels, np.int64)
    if n == 0 or labels.min() == labels.max():
        _, intercept = logistic(np.zeros(n), labels)
        return Model(np.zeros((2, SPACE)), 0.0, 0.0, intercept)
    rest = np.arange(n) % 5 == 4
    counts = np.full((2, SPACE), SMOOTH)
    for f, k in zip(found, labels, strict=True):
        counts[k, unpacked(f)] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    own = np.flatnonzero(~rest)
    w, bias = descend([found[i] for i in own], np.where(labels > 0, 1.0, -1.0)[own], ratio)
    blended = BLEND * w + (1 - BLEND) * np.abs(w).mean()
    model = Model(np.stack([blended * ratio, ratio * ratio]), bias, 1.0, 0.0)
    margins = np.array([model.margin(unpacked(found[i])) for i in np.flatnonzero(rest)])
    if len(set(labels[rest])) < 2:
        margins, rest = np.array([model.margin(unpacked(f)) for f in found]), np.ones(n, bool)
    model.slope, model.intercept = logistic(margins, labels[rest])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS) -> Model:
    """A model from at most ``max_rows`` labelled rows. What comes to the driver is at most SPACE / 8 bytes (32 KB) for each, however long the texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([packed(features(t)) for t in batch.column("text").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([found, batch.column("y")], ["f", "y"])

    rows = map_texts(training_rows(docs, labels, label, PARTS, HELD_OUT, max_rows), work, "f binary, y int").toArrow()
    both = sorted(zip(rows.column("f").to_pylist(), rows.column("y").to_pylist(), strict=True))  # the same order in every run
    return fit([f for f, _ in both], np.array([y for _, y in both], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Only the text is an input of the score. A null text is scored like an empty one; a null ``doc_id`` is not held out
    (its remainder is unknown); repeated rows are scored each by itself, so equal texts tie; texts of any length are read whole (a
    text's features take at most SPACE / 8 bytes); other columns are ignored; an empty table gives an empty result.
    """
    get = share(docs.sparkSession, Model, vars(model))  # two numbers per feature: a fixed 4 MB

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = get().score(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)], ["doc_id", "held_out", "score"])

    held = F.coalesce(remainder(F.col("doc_id").cast("long"), PARTS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    out = map_texts(rows, work, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, max_rows=max_rows))
