"""Bounded labelled samples, and turning margins into probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, by which rows are held out; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, max_rows: int) -> DataFrame:
    """``(text, y)`` of at most ``max_rows`` labelled rows that are not held out, the same ones in every run.

    The ids are drawn from ``labels`` by a hash order (a top-k, no shuffle of the table), so the side that is
    broadcast has a proven bound: ``max_rows`` rows of two numbers. Null ids and null labels teach nothing; of repeated ids the
    larger label counts, and of several texts with one id the smallest.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), parts) != held_out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic regression, by damped Newton steps; finite even for separable data.

    Labels are smoothed as in Platt's method, so scores stay inside (0, 1).
    """
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(x).max()), 1e-12)
    z = x / scale
    w = np.array([0.0, np.log(pos / neg)])
    features = np.stack([z, np.ones_like(z)])

    def loss(v: np.ndarray) -> float:
        m = v @ features
        return float((np.logaddexp(0, m) - t * m).sum() + ridge * v[0] ** 2 / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ features, -40, 40)))
        grad = features @ (p - t) + np.array([ridge * w[0], 0])
        hess = (features * (p * (1 - p) + 1e-9)) @ features.T + np.diag([ridge, 1e-9])
        step, size = np.linalg.solve(hess, grad), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
