"""Choosing forgetting factors from statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from .solve import combine, ridge, squared_error
from .stats import Statistics

#: Fixed values.
GRID = tuple(round(0.05 * k, 3) for k in range(1, 21))
VARIANCE_FLOOR = 1e-3
SCALE_FLOOR = 1e-6
GAINS = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)


def first_smallest(candidates: Sequence[float], objectives: Sequence[float], start: float = 1.0) -> tuple[float, float]:
    """The first of the smallest objectives; ``start`` if none is finite."""
    best, least = start, float("inf")
    for f, o in zip(candidates, objectives, strict=True):
        if o < least:
            best, least = float(f), float(o)
    return best, least


def best_factor(rho: float) -> float:
    r = max(float(rho), 0.0)
    return 1.0 if r == 0.0 else 0.5 * (2.0 + r - np.sqrt(r * r + 4.0 * r))


def held_out_factors(fit: Sequence[Statistics], held: Sequence[Statistics], lam: float, grid: Sequence[float] = GRID, f_min: float = 0.05, f_max: float = 1.0, clip: bool = True, fall_back: bool = False) -> tuple[list[float], list[float | None]]:
    """At each boundary the factor whose solution on the fit part has the least held-out error, averaged over domains.

    A domain without held-out rows counts as no error, or with ``fall_back`` is judged on its fit part.
    """
    factors, objectives = [1.0], [None]
    told = [f if fall_back and h.n == 0 else h for f, h in zip(fit, held, strict=True)]
    for t in range(1, len(fit)):
        errors = []
        for f in grid:
            w = ridge(*combine(fit[: t + 1], float(f)), lam)
            errors.append(float(np.mean([squared_error(w, s) / max(s.n, 1) for s in told[: t + 1]])))
        best, least = first_smallest(grid, errors)
        factors.append(float(np.clip(best, f_min, f_max)) if clip else best)
        objectives.append(least)
    return factors, objectives


@dataclass
class Theory:
    """What the closed-form objective needs of a domain."""

    w: np.ndarray
    mass: float
    noise: float
    rho: float
    n: int
    scale: float


def estimate(full: Sequence[Statistics], fit: Sequence[Statistics], held: Sequence[Statistics], lam: float) -> list[Theory]:
    """Weights and mass from all training rows, noise from held-out ones, targets divided by their mean."""
    out = []
    for whole, part, rest in zip(full, fit, held, strict=True):
        scale = max(whole.y / max(whole.n, 1), SCALE_FLOOR)
        whole, part, rest = whole.scaled(scale), part.scaled(scale), rest.scaled(scale)
        if rest.n == 0:
            part = rest = whole
        mass = float(np.trace(whole.r)) / len(whole.c)
        noise = squared_error(ridge(part.r, part.c, lam), rest) / max(rest.n, 1)
        mean = whole.y / max(whole.n, 1)
        variance = max(whole.yy / max(whole.n, 1) - mean * mean, VARIANCE_FLOOR)
        out.append(Theory(ridge(whole.r, whole.c, lam), mass, noise, mass / max(whole.n, 1) / variance, whole.n, scale))
    return out


def predicted_factor(domains: Sequence[Theory], lam: float, grid: Sequence[float] = GRID, gain: float = 1.0) -> tuple[float, list[tuple[float, float]]]:
    """The factor of least bias plus variance, and the whole curve."""
    mass, noise, rho = (np.array([getattr(d, k) for d in domains]) for k in ("mass", "noise", "rho"))
    w = np.stack([d.w for d in domains])
    age = np.arange(len(domains))[::-1]
    curve = []
    for f in grid:
        share = float(f) ** age * mass
        total = share.sum() + lam
        mixed = (share / total) @ w
        bias = float(np.mean(rho * np.square(mixed - w).sum(axis=1)))
        variance = float((float(f) ** (2 * age) * noise * mass).sum()) / total**2
        curve.append((float(f), float(bias + gain * w.shape[1] * rho.mean() * variance)))
    return first_smallest(*zip(*curve, strict=True))[0], curve


def gain_table(domains: Sequence[Theory], lam: float, gains: Sequence[float] = GAINS) -> dict[float, float]:
    return {g: predicted_factor(domains, lam, gain=g)[0] for g in gains}


def drift_scores(full: Sequence[Statistics], lam: float, factor: float = 1.0) -> list[float | None]:
    """For each domain after the first: mass over the noise of its mean, times the squared distance of its own weights from those before it."""
    out: list[float | None] = [None]
    for k in range(1, len(full)):
        s = full[k]
        own, before = ridge(s.r, s.c, lam), ridge(*combine(full[:k], factor), lam)
        noise = max(squared_error(own, s) / max(s.n, 1), 1e-12)
        out.append(float(np.trace(s.r)) / len(s.c) / (noise / max(s.n, 1)) * float(np.square(own - before).sum()))
    return out
