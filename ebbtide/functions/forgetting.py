"""Forgetting factors as column expressions.

``rho`` is the ratio of drift to noise. The best factor solves f^2 - (2 + rho) f + 1 = 0
with f <= 1; its inverse map gives the ratio that makes a factor best.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE_FLOOR = 1e-12
F_MIN, F_MAX = 0.05, 1.0
GRID_STEP = 0.05


def optimal_factor(rho: Column) -> Column:
    """The best factor for ``rho``; negative ratios count as zero, which gives 1."""
    r = F.greatest(rho.cast("double"), F.lit(0.0))
    return F.when(r == 0, F.lit(1.0)).otherwise(0.5 * (2.0 + r - F.sqrt(r * r + 4.0 * r)))


def ratio_of_factor(f: Column) -> Column:
    return (f * f + 1.0) / f - 2.0


def drift_ratio(energy: Column, floor: Column) -> Column:
    """Excess of an energy over its floor, as a multiple of the floor."""
    return F.greatest(energy - floor, F.lit(0.0)) / F.greatest(floor, F.lit(NOISE_FLOOR))


def factor_from_innovation(energy: Column, floor: Column, f_min: float = F_MIN, f_max: float = F_MAX) -> Column:
    """The clipped best factor; ``f_max`` while there is no floor yet."""
    best = F.least(F.greatest(optimal_factor(drift_ratio(energy, floor)), F.lit(f_min)), F.lit(f_max))
    return F.when(floor.isNull() | energy.isNull(), F.lit(f_max)).otherwise(best)


def noise_floor(energies: Column, keep: float = 0.5) -> Column:
    """Exponential moving average over an ordered array; the first value starts it."""
    return F.aggregate(energies, F.lit(None).cast("double"), lambda a, e: F.when(a.isNull(), e).otherwise(keep * a + (1.0 - keep) * e))


def improvement_percent(base: Column, new: Column) -> Column:
    return 100.0 * (base - new) / F.greatest(base, F.lit(NOISE_FLOOR))


def grid_of_factors() -> Column:
    """0.05, 0.10 .. 1.00 as an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.round(k * F.lit(GRID_STEP), 3))
