"""What the classifiers share: a bounded labelled sample, a logistic fit, and the decision."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bound of a sample: rows of each class, and characters of a row that may be in it.
SAMPLE_ROWS = 3000
ROW_CHARS = 20_000


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """A bounded choice of labelled rows with their whole texts; ``SAMPLE_ROWS`` of each class by the key's hash.

    The choice is a top-k over the narrow labels and at most ``2 * SAMPLE_ROWS`` keys are broadcast to the one scan of
    the texts. Rows without a label or text and texts beyond ``ROW_CHARS`` are not learned from.
    """
    labels = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias(label))
    rank = F.xxhash64(F.col(key).cast("string"), F.lit(17))
    picked = [labels.where(F.col(label) == v).orderBy(rank, key).limit(SAMPLE_ROWS) for v in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    rows = docs.where(F.col(text).isNotNull() & (F.length(text) <= ROW_CHARS)).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.join(F.broadcast(chosen), "_key")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by damped Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x1.shape[1])
    penalty = np.full(x1.shape[1], ridge * weight.sum())
    penalty[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (weight * (p - y)) + penalty * w
        hess = (x1 * (weight * np.maximum(p * (1 - p), 1e-6)).astype(x1.dtype)[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def decide(probability: Column, threshold: float = 0.3) -> Column:
    return (probability >= threshold).cast("int")
