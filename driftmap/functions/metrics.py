"""Distances between vectors, as Column builders over arrays and as numpy tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def sqeuclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqeuclidean(a, b))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; 1 if either vector is zero."""
    return 1 - F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0))


METRICS = {"sqeuclidean": sqeuclidean, "euclidean": euclidean, "cosine": cosine}


def metric(name: str | Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """The Column builder of a metric by name; a builder is returned as it is."""
    if callable(name):
        return name
    if name not in METRICS:
        raise ValueError(f"Metric '{name}' not defined; choose one of {sorted(METRICS)}")
    return METRICS[name]


def tile(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between the rows of x and of y; differences are taken before squaring, as in the Column form."""
    if name == "cosine":
        norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        return 1 - np.divide(x @ y.T, norm, out=np.zeros_like(norm), where=norm > 0)
    out = np.empty((len(x), len(y)))
    for k, row in enumerate(x):
        out[k] = ((row - y) ** 2).sum(1)
    return np.sqrt(out) if name == "euclidean" else out


def rough_tile(name: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A tile, and how far a distance may be off it: squared ones by one product of matrices, others as tile() has them, with 0."""
    if name == "sqeuclidean":
        a, b = (x * x).sum(1), (y * y).sum(1)
        out = np.hstack([-2 * x, a[:, None], np.ones((len(x), 1))]) @ np.hstack([y, np.ones((len(y), 1)), b[:, None]]).T
        # Twice what rounding can add up to in norms, product and exact sum.
        slack = (8 * x.shape[1] + 64) * np.finfo(float).eps * (np.sqrt(a.max()) + np.sqrt(b.max())) ** 2
        if np.isfinite(slack) and slack > 0:
            return out, slack
    return tile(name, x, y), 0.0


def wide_tile(name: str, x: np.ndarray, yt: np.ndarray) -> np.ndarray:
    """All distances between the few rows of x and the many columns of yt; squares are summed by coordinate in order, as in the Column form."""
    if name == "cosine":
        return tile(name, x, yt.T)
    out = np.zeros((len(x), yt.shape[1]))
    columns = max(256, (1 << 15) // len(x))  # what stays in a cache
    for k in range(0, yt.shape[1], columns):
        part = np.zeros((len(x), min(columns, yt.shape[1] - k)))
        diff = np.empty_like(part)
        for c in range(len(yt)):
            np.subtract(x[:, c : c + 1], yt[c, k : k + columns], out=diff)
            diff *= diff
            part += diff
        out[:, k : k + columns] = part
    return np.sqrt(out, out=out) if name == "euclidean" else out


def of_pairs(name: str, x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The squared distances of the rows x[at] and y[to], summed by coordinate in order, as in the Column form."""
    assert name == "sqeuclidean"
    out = np.zeros(len(at))
    for c in range(x.shape[1]):
        diff = x[at, c] - y[to, c]
        out += diff * diff
    return out


def spread(points: DataFrame) -> DataFrame:
    """points (i, ...) dealt evenly to as many tasks as there are cores: the side of a cross join that its work is split by."""
    return points.repartition(points.sparkSession.sparkContext.defaultParallelism, "i")
