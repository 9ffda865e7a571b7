"""Square grids of patch targets: cells, smoothing and resizing."""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = 1e-6
ZERO_SUM = 1e-12


def side_of(cells: int) -> int:
    g = round(math.sqrt(cells))
    if g * g != cells:
        raise ValueError(f"{cells} cells make no square grid")
    return g


def cell(px: Column, py: Column, width: Column, height: Column, g: int, size: int = 518) -> Column:
    """Row-major cell number of a point of an image that is scaled to ``size`` pixels either way."""

    def step(p: Column, extent: Column) -> Column:
        scaled = F.least(F.greatest(p * (F.lit(float(size)) / F.greatest(extent, F.lit(1))), F.lit(0.0)), F.lit(size - EDGE))
        return F.least(F.greatest(F.floor(scaled / size * g), F.lit(0)), F.lit(g - 1))

    return (step(py, height) * g + step(px, width)).cast("int")


@cache
def dct_basis(g: int, k: int) -> np.ndarray:
    """The first k orthonormal DCT-II vectors of length g, as columns."""
    basis = np.cos(np.pi / g * np.outer(np.arange(g) + 0.5, np.arange(k))) * math.sqrt(2.0 / g)
    basis[:, 0] = math.sqrt(1.0 / g)
    return basis


def keep_sum(new: np.ndarray, total: float) -> np.ndarray:
    now = new.sum()
    return new * (total / now) if abs(now) > ZERO_SUM else new


def dct_lowpass(grid: np.ndarray, k: int) -> np.ndarray:
    """The grid's k lowest frequencies either way, clipped at zero and rescaled to the grid's sum."""
    g = len(grid)
    smooth = dct_basis(g, min(max(k, 1), g))
    smooth = smooth @ smooth.T
    return keep_sum(np.maximum(smooth @ grid @ smooth, 0.0), float(grid.sum()))


def gaussian_matrix(g: int, sigma: float) -> np.ndarray:
    """The linear map of one Gaussian pass over g cells with zeros outside."""
    radius = max(1, math.ceil(3.0 * sigma))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(sigma, 1e-12)) ** 2)
    weights /= weights.sum()
    apart = np.arange(g)[:, None] - np.arange(g)[None, :]
    return np.where(abs(apart) <= radius, weights[np.clip(apart + radius, 0, 2 * radius)], 0.0)


def gaussian_smooth(grid: np.ndarray, sigma: float) -> np.ndarray:
    pass_ = gaussian_matrix(len(grid), sigma)
    return keep_sum(np.maximum(pass_ @ grid @ pass_.T, 0.0), float(grid.sum()))


def target_transform(mode: str):
    """The function of a flat target that a mode names: raw, dct<k> or gauss<sigma>."""
    if mode == "raw":
        return lambda y: np.asarray(y, float)
    known = re.fullmatch(r"(dct)(\d+)|(gauss)(\d+\.?\d*|\.\d+)", mode)
    if known is None:
        raise ValueError(f"unknown target mode {mode!r}; raw, dct<k> and gauss<sigma> are known")

    smooth, strength = (dct_lowpass, int(known[2])) if known[1] else (gaussian_smooth, float(known[4]))

    def apply(y) -> np.ndarray:
        y = np.asarray(y, float)
        g = side_of(len(y))
        return smooth(y.reshape(g, g), strength).reshape(-1)

    return apply


def triangle_weights(old: int, new: int) -> np.ndarray:
    """Weights (new x old) of a resize with a triangle filter, widened when shrinking."""
    scale = old / new
    width = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    weights = np.maximum(0.0, 1.0 - np.abs((np.arange(old)[None, :] + 0.5 - centre[:, None]) / width))
    return weights / weights.sum(axis=1, keepdims=True)


def depth_to_cells(depth: np.ndarray, size: int, cells: int) -> np.ndarray:
    """Mean depth of each cell after a bilinear resize to size x size; ``size`` must be a multiple of the side."""
    g = side_of(cells)
    if size % g:
        raise ValueError(f"size {size} is no multiple of the grid side {g}")
    full = triangle_weights(depth.shape[0], size) @ depth.astype(float) @ triangle_weights(depth.shape[1], size).T
    return full.reshape(g, size // g, g, size // g).mean(axis=(1, 3)).reshape(-1)
