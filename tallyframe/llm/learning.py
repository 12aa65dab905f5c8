"""Labelled samples and small numpy models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.session import materialise


def labelled_sample(documents: DataFrame, labels: DataFrame, learn: Column, most: int, label: str) -> DataFrame:
    """About ``most`` (doc_id, text, y) rows at most, of distinct texts whose ids may be learnt from.

    A null label or id is no label. Where an id or a text has several labels, the least counts. First ids are
    chosen by their hash, then, as ids may repeat, the texts that carry them by theirs; both lists are that
    short, so they are sent to the documents and no text is shuffled but those chosen.
    """
    def chosen(rows: DataFrame, *key: str) -> DataFrame:
        share = most / max(rows.count(), 1)
        return rows if share >= 1 else rows.where(F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))

    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.min(label).alias("y"))
    ids = materialise(chosen(materialise(known, "labels"), "doc_id"), "labels")
    hashed = documents.select("doc_id", "text", F.xxhash64("text", F.col("text").isNull()).alias("_hash"))
    texts = hashed.join(F.broadcast(ids), "doc_id").groupBy("_hash").agg(F.min("doc_id").alias("doc_id"), F.min("y").alias("y"))
    kept = materialise(chosen(materialise(texts, "labels"), "_hash"), "labels")
    rows = hashed.join(F.broadcast(kept), ["doc_id", "_hash"])
    return rows.groupBy("doc_id", "_hash", "y").agg(F.first("text").alias("text")).select("doc_id", "text", "y")


def logistic(features: np.ndarray, truth: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the first feature is the constant."""
    weights = np.zeros(features.shape[1])
    penalty = ridge * np.eye(len(weights))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        change = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + penalty, features.T @ (p - truth) + penalty @ weights)
        weights -= change
        if np.abs(change).max() < 1e-8:
            break
    return weights
