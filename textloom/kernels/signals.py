"""Savitzky-Golay filters, minima, percentile filters and similarity of vector series, on numpy arrays."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from math import factorial

import numpy as np


@lru_cache(maxsize=256)
def savgol_weights(window: int, order: int, deriv: int = 0) -> np.ndarray:
    """The least-squares weights as fractions, each rounded once: a slope or curvature at its limit depends on their last bit."""
    if window % 2 == 0 or window <= order or order < 0 or deriv < 0:
        raise ValueError("window must be odd and above the order")
    weights = np.zeros(window)
    if deriv <= order:
        x = [i - window // 2 for i in range(window)]
        c = _solved([[Fraction(sum(v ** (j + k) for v in x)) for k in range(order + 1)] + [Fraction(j == deriv)] for j in range(order + 1)])
        weights[:] = [float(factorial(deriv) * sum(c[k] * v**k for k in range(order + 1))) for v in x]
    weights.setflags(write=False)
    return weights


def _solved(rows: list[list[Fraction]]) -> list[Fraction]:
    """Gauss-Jordan elimination of a positive definite matrix with its right side in the last column."""
    for i in range(len(rows)):
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for k in range(len(rows)):
            if k != i:
                rows[k] = [v - rows[k][i] * u for v, u in zip(rows[k], rows[i])]
    return [row[-1] for row in rows]


def reflected(n: int, half: int) -> np.ndarray:
    """(n x window) places, mirrored at the ends without repeating them, then clamped."""
    at = np.arange(n)[:, None] + np.arange(-half, half + 1)
    at = np.where(at < 0, -at, at)
    at = np.where(at >= n, 2 * n - at - 2, at)
    return np.clip(at, 0, n - 1)


def savgol(values, window: int = 5, order: int = 3, deriv: int = 0) -> np.ndarray:
    values = np.asarray(values, float)
    weights = savgol_weights(window, order, deriv)
    if not len(values):
        raise ValueError("data must not be empty")
    near = values[reflected(len(values), window // 2)]
    return sum(near[:, j] * w for j, w in enumerate(weights))  # from the left, as the window functions add


def minima(values, window: int = 11, order: int = 2, tolerance: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Places where the first derivative is near 0 and the second positive, and the values there."""
    values = np.asarray(values, float)
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.flatnonzero((np.abs(savgol(values, window, order, 1)) < tolerance) & (savgol(values, window, order, 2) > 0))
    return at, values[at]


def filter_splits(places, values, threshold: float = 0.5, distance: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Those not above the values' percentile, each ``distance`` or more after the last one taken."""
    places, values = np.asarray(places, np.int64), np.asarray(values, float)
    if not len(places):
        return places, values
    limit = np.quantile(values, threshold)
    kept: list[int] = []
    for i in np.flatnonzero(values <= limit):
        if not kept or places[i] - places[kept[-1]] >= distance:
            kept.append(int(i))
    return places[kept], values[kept]


def cosine(a, b) -> float:
    """In single precision; 0 for unequal lengths and zero vectors."""
    a, b = np.asarray(a, np.float32), np.asarray(b, np.float32)
    if len(a) != len(b) or not len(a):
        return 0.0
    norm = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float(a @ b / norm) if norm > 0 else 0.0


def cross_similarity(vectors, window: int = 3) -> np.ndarray:
    """Neighbours' cosines, averaged over a window of pairs; zero vectors' pairs don't count."""
    x = np.asarray(vectors, float)
    if window < 3 or window % 2 == 0 or len(x) < 2:
        raise ValueError("window must be odd and 3 or more, with two vectors at least")
    norm = np.linalg.norm(x[:-1], axis=1) * np.linalg.norm(x[1:], axis=1)
    pair = np.where(norm > 0, (x[:-1] * x[1:]).sum(axis=1) / np.where(norm > 0, norm, 1), 0)
    total, count = np.concatenate([[0], np.cumsum(pair)]), np.concatenate([[0], np.cumsum(norm > 0)])
    n, half = len(x), window // 2
    a = np.maximum(np.arange(n - 1) - half, 0)
    z = np.minimum(np.minimum(n, np.arange(n - 1) + half + 2) - 1, n - 1)
    return np.where(count[z] > count[a], (total[z] - total[a]) / np.maximum(count[z] - count[a], 1), 0.0)
