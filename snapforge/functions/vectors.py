"""Distances between vectors. Lower is nearer, for all metrics.

l2 is squared; cosine is 1 - dot / (|a| |b| + 1e-10), so a zero vector is at 1 of everything; dot is
negated. Vectors are stored as 32-bit floats; distances are summed in 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from snapforge.errors import ConfigError

METRICS = ("l2", "cosine", "dot_product")
TINY = 1e-10


def metric_name(metric: str) -> str:
    name = {"dot": "dot_product", "ip": "dot_product", "euclidean": "l2"}.get(metric.lower(), metric.lower())
    if name not in METRICS:
        raise ConfigError(f"no such metric: {metric}; there are {', '.join(METRICS)}")
    return name


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Between array columns, by built-in functions."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    if metric_name(metric) == "l2":
        return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    if metric_name(metric) == "dot_product":
        return -dot
    norm = lambda x: F.sqrt(_sum(F.transform(x, lambda v: v * v)))
    return F.lit(1.0) - dot / (norm(a) * norm(b) + F.lit(TINY))


def distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """(queries, vectors) at once."""
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    dot = q @ v.T
    if metric_name(metric) == "dot_product":
        return -dot
    if metric_name(metric) == "cosine":
        return 1.0 - dot / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :] + TINY)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in q]) if len(q) else dot
