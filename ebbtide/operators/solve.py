"""Solving for weights on the driver, from statistics alone. The bias is penalised like any component."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import Statistics


def combine(stats: Sequence[Statistics], factors: float | Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """(R, C) after the last of the domains; a list has the factor applied at each boundary (the first counts for nothing)."""
    given = [float(factors)] * len(stats) if isinstance(factors, (int, float)) else list(factors)
    r, c = np.zeros_like(stats[0].r), np.zeros_like(stats[0].c)
    for f, s in zip(given, stats, strict=True):
        r, c = f * r + s.r, f * c + s.c
    return r, c


def ridge(r: np.ndarray, c: np.ndarray, lam: float) -> np.ndarray:
    return np.linalg.solve(r + lam * np.eye(len(c)), c)


def weights_by_boundary(stats: Sequence[Statistics], factors: float | Sequence[float], lam: float) -> list[np.ndarray]:
    """The model after each domain."""
    given = [float(factors)] * len(stats) if isinstance(factors, (int, float)) else list(factors)
    return [ridge(*combine(stats[: t + 1], given[: t + 1]), lam) for t in range(len(stats))]


def squared_error(w: np.ndarray, s: Statistics) -> float:
    """Sum of squared residuals of unclipped predictions, from statistics."""
    return float(w @ s.r @ w - 2 * w @ s.c + s.yy)


def ridge_two(cells: DataFrame, keys: Sequence[str], lam: float) -> DataFrame:
    """(keys, w0, w1): the closed form for one feature and a bias, in SQL."""
    at = lambda kind, i, j: F.sum(F.when((F.col("kind") == kind) & (F.col("i") == i) & (F.col("j") == j), F.col("v")))
    wide = cells.groupBy(*keys).agg(at("r", 0, 0).alias("a"), at("r", 0, 1).alias("b"), at("r", 1, 1).alias("d"), at("c", 0, -1).alias("p"), at("c", 1, -1).alias("q"))
    a, b, d, p, q = F.col("a") + lam, F.col("b"), F.col("d") + lam, F.col("p"), F.col("q")
    det = a * d - b * b
    return wide.select(*keys, ((d * p - b * q) / det).alias("w1"), ((a * q - b * p) / det).alias("w0"))
