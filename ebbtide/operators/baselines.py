"""Gradient baselines. The full-batch one needs statistics only; the per-sample one streams an ordered group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .stats import Statistics

#: Fixed values.
DECAY_1, DECAY_2, EPSILON = 0.9, 0.999, 1e-8
VARIANCE_FLOOR = 1e-6


def standardizer(s: Statistics, floor: str = "variance") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the features (the bias is last); ``floor`` "variance" keeps the variance, "added" adds to the deviation."""
    mean = s.r[:-1, -1] / max(s.n, 1)
    variance = np.diag(s.r)[:-1] / max(s.n, 1) - mean * mean
    if floor == "variance":
        return mean, np.sqrt(np.maximum(variance, VARIANCE_FLOOR))
    return mean, np.sqrt(np.maximum(variance, 0.0)) + VARIANCE_FLOOR


def standardized(s: Statistics, mean: np.ndarray, spread: np.ndarray) -> Statistics:
    """The statistics of (x - mean) / spread, with the bias kept."""
    d = len(mean)
    turn = np.eye(d + 1)
    turn[:d, :d] = np.diag(1 / spread)
    turn[d, :d] = -mean / spread
    return Statistics(turn.T @ s.r @ turn, turn.T @ s.c, s.yy, s.y, s.n)


class Adam:
    def __init__(self, width: int, rate: float):
        self.w, self.rate, self.step = np.zeros(width), rate, 0
        self.first, self.second = np.zeros(width), np.zeros(width)

    def move(self, slope: np.ndarray) -> None:
        self.step += 1
        self.first = DECAY_1 * self.first + (1 - DECAY_1) * slope
        self.second = DECAY_2 * self.second + (1 - DECAY_2) * slope * slope
        self.w = self.w - self.rate * (self.first / (1 - DECAY_1**self.step)) / (np.sqrt(self.second / (1 - DECAY_2**self.step)) + EPSILON)


def full_batch(stats: Sequence[Statistics], epochs: int = 15, rate: float = 0.01, penalty: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(weights after each domain, mean, spread): the first domain standardises, the state goes on over domains."""
    mean, spread = standardizer(stats[0], "added")
    adam, out = Adam(len(stats[0].c), rate), []
    for s in stats:
        z = standardized(s, mean, spread)
        for _ in range(epochs):
            adam.move((z.r @ adam.w - z.c) / max(z.n, 1) + penalty * adam.w)
        out.append(adam.w.copy())
    return out, mean, spread


def per_sample(samples: DataFrame, mean: np.ndarray, spread: np.ndarray, epochs: int = 10, rate: float = 0.01, penalty: float = 1e-4) -> DataFrame:
    """(domain_id, w): weights after each domain, one step a sample in order (domain_id, ord, x, y).

    Each step needs the one before, so the rows go through one ordered group; give it
    one row per sample, not per patch.
    """
    ship_package(samples.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        adam, out = Adam(len(mean) + 1, rate), []
        for domain, own in rows.sort_values(["domain_id", "ord"], kind="stable").groupby("domain_id", sort=True):
            xs = np.column_stack([(np.stack(own["x"].to_list()) - mean) / spread, np.ones(len(own))])
            for _ in range(epochs):
                for x, y in zip(xs, own["y"].to_numpy(), strict=True):
                    adam.move(x * (x @ adam.w - y) + penalty * adam.w)
            out.append((domain, adam.w.tolist()))
        return pd.DataFrame(out, columns=["domain_id", "w"])

    told = samples.select(F.col("domain_id").cast("long"), F.col("ord").cast("long"), F.col("x").cast("array<double>"), F.col("y").cast("double"))
    return told.groupBy().applyInPandas(run, "domain_id long, w array<double>")
