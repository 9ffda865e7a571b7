"""Vectors in array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(x: Column) -> Column:
    return x.cast("array<double>")


def with_bias(x: Column) -> Column:
    return F.concat(x, F.array(F.lit(1.0)))


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def predict(x: Column, w: Column, non_negative: bool = True) -> Column:
    """x (with a bias component) times w, clipped at zero row by row."""
    out = dot(with_bias(x), w)
    return F.greatest(out, F.lit(0.0)) if non_negative else out


def blend(patch_sum: Column, image: Column, alpha: Column | float, scale: Column | float = 1.0) -> Column:
    """Two heads' counts, mixed, brought back to raw units and clipped."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    s = F.lit(scale) if isinstance(scale, float) else scale
    return F.greatest((a * patch_sum + (1.0 - a) * image) * s, F.lit(0.0))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def projection_matrix(d_in: int, d_out: int, seed: int = 0) -> np.ndarray:
    """Fixed Gaussian weights over the square root of the width, from one seeded generator."""
    return np.random.default_rng(seed).standard_normal((d_in, d_out)) / np.sqrt(d_in)


def project(x: np.ndarray, matrix: np.ndarray | None) -> np.ndarray:
    return x if matrix is None else np.maximum(x @ matrix, 0.0)
