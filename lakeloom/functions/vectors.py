"""Distance kernels over blocks of vectors; lower is closer except for the inner product."""

from __future__ import annotations

import numpy as np

METRICS = ("l2", "ip", "cosine", "hamming", "jaccard")


def distances(metric: str, base: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Matrix (queries x base). `hamming` and `jaccard` compare the sign bits of the vectors."""
    if metric == "l2":
        squares = (base**2).sum(1)[None, :] + (queries**2).sum(1)[:, None] - 2 * queries @ base.T
        return np.sqrt(np.maximum(squares, 0))
    if metric == "ip":
        return queries @ base.T
    if metric == "cosine":
        norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(base, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            # A zero vector has no direction: treat it as orthogonal to everything.
            return np.where(norms > 0, 1 - (queries @ base.T) / norms, 1.0)
    b, q = (base > 0).astype(np.float64), (queries > 0).astype(np.float64)
    both = q @ b.T
    ones = q.sum(1)[:, None] + b.sum(1)[None, :]
    if metric == "hamming":
        return ones - 2 * both
    if metric == "jaccard":
        either = ones - both
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(either > 0, 1 - both / either, 0.0)
    raise ValueError(f"unknown metric {metric!r}")


def closer_sign(metric: str) -> float:
    """Factor that turns a distance into a sort key where lower is closer."""
    return -1.0 if metric == "ip" else 1.0
