"""Bounded labelled samples and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import bounded_batches


def sample(labels: DataFrame, label: str, rows: int, seed: int = 3) -> DataFrame:
    """At most ``rows`` labelled ids (l_id, l_label), the least by hash; an id
    with several labels takes the largest; null ids and labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col(label).cast("int").alias("l_label"))
    known = known.where("l_id IS NOT NULL AND l_label IS NOT NULL").groupBy("l_id").agg(F.max("l_label").alias("l_label"))
    return known.orderBy(F.xxhash64("l_id", F.lit(seed)), "l_id").limit(rows)


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text, label of the sampled rows; repeated ids count once."""
    own = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # bounded: at most the sample's rows of two numbers
    rows = own.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).withColumnRenamed("l_label", "label")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_dense(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised columns:
    (weights with the intercept first, means, scales).  With one class or no
    rows only the intercept is fitted, towards the smoothed rate."""
    n, k = x.shape
    mean = x.mean(0) if n else np.zeros(k)
    scale = np.where((s := x.std(0) if n else np.ones(k)) > 1e-9, s, 1.0)
    w = np.zeros(k + 1)
    rate = (y.sum() + 1.0) / (n + 2.0)
    w[0] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return w, mean, scale
    z = np.hstack([np.ones((n, 1)), (x - mean) / scale])
    penalty = np.r_[1e-3, np.full(k, ridge)]
    for _ in range(steps):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale
