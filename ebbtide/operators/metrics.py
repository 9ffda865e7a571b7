"""Errors, task matrices and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE_FLOOR = 1e-6
DENOMINATOR_FLOOR = 1e-12


def mae(pred: Column, truth: Column) -> Column:
    return F.avg(F.abs(pred - truth))


def relative_mae(pred: Column, truth: Column, absolute: bool = False) -> Column:
    """MAE over the mean target, or over the mean of its size where targets can be negative."""
    return mae(pred, truth) / F.greatest(F.avg(F.abs(truth) if absolute else truth), F.lit(SCALE_FLOOR))


def domain_scale(rows: DataFrame, keys: Sequence[str], sample: str, y: str, floor: float | None = SCALE_FLOOR) -> DataFrame:
    """Mean over samples of their total target, per key; ``floor`` None leaves it as it is."""
    totals = rows.groupBy(*keys, sample).agg(F.sum(y).alias("total"))
    scale = F.avg("total")
    return totals.groupBy(*keys).agg((scale if floor is None else F.greatest(scale, F.lit(floor))).alias("scale"))


def residual_energies(rows: DataFrame, keys: Sequence[str], sample: str, pred: Column, y: Column) -> DataFrame:
    """Squared residuals per key: over all rows (also the row-weighted mean of samples), and the plain mean of sample means."""
    square = (y - pred) * (y - pred)
    per_sample = rows.groupBy(*keys, sample).agg(F.avg(square).alias("e"), F.count("*").alias("n"))
    return per_sample.groupBy(*keys).agg((F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("weighted"), F.avg("e").alias("unweighted"), F.sum("n").alias("n"))


def task_summary(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """final_avg, nbwt, oldest and newest of sparse task matrices (t, i, value), i <= t; null and NaN count as not evaluated."""
    told = matrix.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row a cell of a matrix
    own = F.max(F.when(F.col("i") == F.col("t"), F.col("value"))).over(Window.partitionBy(*keys, "i"))
    final = told.withColumns({"__t": F.max("t").over(whole), "__own": own}).where(F.col("t") == F.col("__t"))
    gain = F.when(F.col("i") < F.col("__t"), (F.col("__own") - F.col("value")) / F.greatest(F.abs("__own"), F.lit(DENOMINATOR_FLOOR)))
    return final.groupBy(*keys).agg(
        F.avg("value").alias("final_avg"), F.coalesce(F.avg(gain), F.lit(0.0)).alias("nbwt"),
        F.max(F.when(F.col("i") == 0, F.col("value"))).alias("oldest"), F.max(F.when(F.col("i") == F.col("__t"), F.col("value"))).alias("newest"),
    )


def argmin(rows: DataFrame, keys: Sequence[str], choice: str, objective: str, position: str) -> DataFrame:
    """The choice of smallest objective per key, the first of equals; null and NaN objectives never win."""
    told = rows.where(F.col(objective).isNotNull() & ~F.isnan(objective))
    return told.groupBy(*keys).agg(F.min_by(choice, F.struct(objective, position)).alias(f"best_{choice}"), F.min(objective).alias(f"best_{objective}"))


def describe(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, min, max and population deviation per key."""
    v = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))


def forgetting_verdict(f_none: Column, f_mean: Column) -> Column:
    """What the best factors without and with normalised targets say."""
    return (
        F.when((f_none < 0.95) & (f_mean >= 0.9), "scale artifact")
        .when((f_none < 0.95) & (f_mean < 0.9), "genuine drift")
        .otherwise("no forgetting needed")
    )


def adaptive_verdict(base: Column, oracle: Column, adaptive: Column) -> Column:
    """How selected factors compare with full memory (tolerance 1e-4) and the best fixed factor (0.03)."""
    loses = adaptive > base + 1e-4
    return F.when(~loses & (adaptive - oracle <= 0.03), "good").when(loses, "worse than full memory").otherwise("far from the best fixed factor")


def scalar_verdict(f_mean: Column) -> Column:
    """Whether forgetting helps once targets are normalised."""
    return F.when(f_mean < 0.9, "forgetting helps").otherwise("no forgetting needed")
