"""Training split and bounded label samples, shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# fixed at this resolution, a sample is a range of hashed ids
STEPS = 1 << 20


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, mod ``folds``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


class LabelSample:
    """Labels of hashed-chosen ids, sorted by id, small enough for every task."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.labels = ids[order], labels[order]

    def __len__(self) -> int:
        return len(self.ids)

    def __call__(self, doc_ids: pa.Array) -> np.ndarray:
        """Label of every id, -1 where there is none."""
        if isinstance(doc_ids, pa.ChunkedArray):
            doc_ids = doc_ids.combine_chunks()
        known = ~np.asarray(doc_ids.is_null())
        ids = doc_ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(known & (self.ids[at] == ids), self.labels[at], -1)


def label_sample(labels: DataFrame, label: str, folds: int, held: int, max_rows: int) -> LabelSample:
    """At most about ``max_rows`` labelled ids outside fold ``held``, chosen by hash.

    Rows without id or label do not count; an id with several labels has the larger.
    """
    usable = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .dropna()
        .where(fold_of(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total = usable.count()
    if total > max_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) < int(STEPS * max_rows / total))
    table = usable.toArrow()
    return LabelSample(
        table.column("doc_id").cast(pa.int64()).to_numpy(), table.column("label").cast(pa.int64()).to_numpy()
    )


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights[1:] + weights[0]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Bias and weights by Newton steps; without both classes, the smoothed base rate."""
    weights = np.zeros(x.shape[1] + 1)
    rate = (y.sum() + 0.5) / (len(y) + 1.0 + 1e-9) if len(y) else 0.25
    weights[0] = np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():
        return weights
    scale = np.maximum(x.std(axis=0), 1e-9)
    design = np.column_stack([np.ones(len(x)), x / scale])
    penalty = ridge * len(y) / 1000 * np.eye(design.shape[1])
    penalty[0, 0] = 1e-9
    w = np.zeros(design.shape[1])
    w[0] = weights[0]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        gradient = design.T @ (p - y) + penalty @ w
        curve = (design * (p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    weights[0], weights[1:] = w[0], w[1:] / scale
    return weights
