"""Plain versions of operators, for groups that fit in one array."""

from __future__ import annotations

import numpy as np


def principal(x: np.ndarray, k: int) -> np.ndarray:
    """The first k principal components of centred, unscaled columns."""
    if not len(x):
        return x
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return (u * s)[:, :k]


def local_outlier_factor(x: np.ndarray, neighbours: int = 30, share: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(factor, is it an inlier): local density compared with the neighbours'; the share with the largest factors is out."""
    n = len(x)
    k = min(neighbours, n - 1)
    if k < 1:
        return np.ones(n), np.ones(n, bool)
    near, distance = np.empty((n, k), np.int64), np.empty((n, k))
    step = max(1, (1 << 22) // (n * x.shape[1]))
    for lo in range(0, n, step):  # a block of rows at a time
        far = np.sqrt(((x[lo : lo + step, None] - x[None]) ** 2).sum(2))
        far[np.arange(len(far)), np.arange(lo, lo + len(far))] = np.inf
        near[lo : lo + step] = np.argsort(far, axis=1, kind="stable")[:, :k]
        distance[lo : lo + step] = np.take_along_axis(far, near[lo : lo + step], 1)
    radius = distance[:, -1]
    density = 1 / (np.maximum(distance, radius[near]).mean(1) + 1e-10)
    factor = density[near].mean(1) / density
    return factor, factor <= np.quantile(factor, 1 - share)
