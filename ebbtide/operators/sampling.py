"""Bands, splits, samples and bins over ordered rows.

Splits that a seeded generator draws are drawn on the driver, as positions only, and
joined back; everything else is a filter or a window. Positions come from an explicit
order column, never from the order in which rows happen to arrive.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALIDATION_EVERY = 5
AGE_SHUFFLE_SEED = 12345
SAMPLES_A_RANGE = 20
ROWS_A_RANGE = 250_000
LEAST_RANGES, MOST_RANGES = 8, 512


def band(value: Column, low: float, high: float, closed: bool) -> Column:
    """low <= value, and value <= high if ``closed``, else value < high. NaN is in no band."""
    upper = value <= high if closed else value < high
    return (value >= low) & upper & ~F.isnan(value)


def in_values(value: Column, listed: str) -> Column:
    """The trimmed value is among the comma-separated ones, compared as text."""
    return F.trim(value).isin(*listed.split(","))


def with_position(rows: DataFrame, keys: Sequence[str], *order: str, name: str = "position") -> DataFrame:
    """The zero-based position of each row within its keys: no task holds all rows of a key.

    Rows are ranked within ranges of keys and order; the sizes of the ranges before that hold the same keys are added.
    """
    inside = rows.withColumn("__range", range_of(rows, [*keys, *order], splitters(rows, [*keys, *order])))
    sizes = inside.groupBy("__range", *keys).agg(F.count("*").alias("__size"))
    earlier = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__size")
    before = sizes.select(F.col("__range").alias("__of"), *(F.col(k).alias(f"__{k}") for k in keys), earlier.alias("__before"))
    ranked = inside.withColumn("__inner", F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order)))
    same = [F.col("__range") == F.col("__of"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)]
    return ranked.join(F.broadcast(before), same).withColumn(name, F.col("__before") + F.col("__inner") - 1).select(*rows.columns, name)  # a row a range and key


def is_validation(position: Column, every: int = VALIDATION_EVERY) -> Column:
    return position % every == every - 1


def tertile(rank: Column, n: Column) -> Column:
    """0, 1, 2 by one-based rank among n, cut at n div 3 and 2n div 3: what does not divide goes to the last bins."""
    return F.when(rank <= F.floor(n / 3), 0).when(rank <= F.floor(2 * n / 3), 1).otherwise(2)


def count_bins(rows: DataFrame, count: str, tie: str) -> DataFrame:
    """Rows with ``bin`` by tertile of ``count``, ties by ``tie``."""
    return with_global_rank(rows, [count, tie]).withColumn("bin", tertile(F.col("rank"), F.col("n"))).drop("n", "rank")


def hash_sample(rows: DataFrame, by: Sequence[str], size: int, total: int) -> DataFrame:
    """At most ``size`` of ``total`` rows, drawn by a hash of some columns.

    A share of about twice as many is cut out by the hash first, so that tasks have
    little to order and to send, however many there are.
    """
    mark = F.xxhash64(*by)
    if 2 * size < total:
        rows = rows.where(mark < int(-(2**63) + 2 * size / total * 2**64))
    return rows.orderBy(mark, *by).limit(size)


def splitters(rows: DataFrame, order: Sequence[str]) -> list:
    """Keys that cut the order into about even ranges, as many as the rows need, from a bounded sample drawn by hash."""
    total = rows.count()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-total // ROWS_A_RANGE)))
    sample = hash_sample(rows.select(*order), order, SAMPLES_A_RANGE * ranges, total).orderBy(*order).collect()
    return sample[SAMPLES_A_RANGE::SAMPLES_A_RANGE]


def range_of(rows: DataFrame, order: Sequence[str], cuts: Sequence) -> Column:
    """The number of the range that a row's key falls in, by binary search over the cuts."""
    key = F.struct(*order)
    types = {f.name: f.dataType for f in rows.schema.fields}

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        cut = F.struct(*(F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, cuts[middle], strict=True)))
        return F.when(key < cut, search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(cuts))


def with_global_rank(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One-based ``rank`` in the ascending order of these columns, nulls first, and ``n``, the number of rows.

    Rows are ranked within ranges of the order and the sizes of the ranges before are
    added, so that no task holds all rows. A row's range depends on its key alone, so
    sizes and ranks agree however often either is computed. Equal keys share a range:
    give a tie-breaker where one value is very common.
    """
    inside = rows.withColumn("__range", range_of(rows, order, splitters(rows, order)))
    sizes = inside.groupBy("__range").agg(F.count("*").alias("__size"))
    every = Window.partitionBy(F.lit(0)).orderBy("__range")  # a row a range
    before = sizes.select("__range", (F.sum("__size").over(every) - F.col("__size")).alias("__before"), F.sum("__size").over(Window.partitionBy(F.lit(0))).alias("n"))
    ranked = inside.withColumn("__inner", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return ranked.join(F.broadcast(before), "__range").withColumn("rank", F.col("__before") + F.col("__inner")).drop("__range", "__inner", "__before")


def equal_chunks(rows: DataFrame, order: Sequence[str], chunks: int, train_share: float = 0.8) -> DataFrame:
    """Rows with ``chunk`` and ``split``: n div chunks rows each, in order; the remainder goes."""
    size = F.floor(F.col("n") / chunks)
    ranked = with_global_rank(rows, order)
    within = (F.col("rank") - 1) % size
    return ranked.where(F.col("rank") <= size * chunks).withColumn("chunk", F.floor((F.col("rank") - 1) / size)).withColumn("split", F.when(within < F.floor(size * F.lit(train_share)), "train").otherwise("test")).drop("rank", "n")


def sample_positions(n: int, k: int, seed: int) -> list[int]:
    """k of n positions without repeats, sorted; all if there are no more."""
    return list(range(n)) if n <= k else sorted(np.random.default_rng(seed).choice(n, size=k, replace=False).tolist())


def share_split(n: int, train_ratio: float, seed: int, kind: str) -> tuple[list[int], list[int]]:
    """(train, test) positions in stream order.

    "scores": the head of a permutation is the test part, its size from the other share, both unsorted.
    "quality": the head is the train part, both sorted.
    "ages": a fixed shuffle whose head is the test part.
    "counts": the head is the test part, its size rounded half to even.
    """
    if kind == "quality":
        order = np.random.default_rng(seed).permutation(n).tolist()
        cut = max(1, int(n * train_ratio))
        return sorted(order[:cut]), sorted(order[cut:])
    if kind == "scores":
        order = np.random.default_rng(seed).permutation(n).tolist()
        cut = max(1, int(n * (1 - train_ratio)))
    elif kind in ("ages", "counts"):
        order = list(range(n))
        random.Random(AGE_SHUFFLE_SEED if kind == "ages" else seed).shuffle(order)
        cut = max(1, int(n * (1 - train_ratio)) if kind == "ages" else round(n * (1 - train_ratio)))
    else:
        raise ValueError(f"unknown split kind {kind!r}")
    return order[cut:], order[:cut]


def pick_positions(rows: DataFrame, positions: Sequence[int], position: str = "position") -> DataFrame:
    """The rows at these positions, with ``stream_order``, their place in the list. The list comes from the driver, a number a row picked."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(int(p), i) for i, p in enumerate(positions)], f"{position} int, stream_order int")
    return rows.join(listed, position)
