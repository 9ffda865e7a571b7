"""Pairing samples with their labels: the joins of the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import stem

#: Label files by image stem, the first that exists counts.
SHANGHAI_LABELS = ("GT_{stem}.mat", "{stem}.mat", "GT_{stem}.txt", "{stem}.txt")
QNRF_LABELS = ("{stem}_ann.mat", "{stem}.mat", "GT_{stem}.mat")
NYU_LABELS = ("{stem}.png", "{stem}_depth.png")
IMAGE_SUFFIXES = ("", ".jpg", ".jpeg", ".png", ".bmp")


class NoPairs(ValueError):
    """A filter or a join left nothing of a domain."""


def pair_by_stem(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, image, label) for files (path) whose stems agree."""
    left = images.select(stem(F.col("path")).alias("stem"), F.col("path").alias("image"))
    right = labels.select(stem(F.col("path")).alias("stem"), F.col("path").alias("label"))
    return left.join(right, "stem")


def first_candidate(items: DataFrame, names: Sequence[Column], files: DataFrame, item: str = "item", name: str = "name") -> DataFrame:
    """``items`` with ``found``, the first of their candidate names that is in ``files``; items without any go."""
    ranked = items.withColumn("__names", F.array(*names)).select("*", F.posexplode("__names").alias("__rank", "__name")).drop("__names")
    there = ranked.join(files.select(F.col(name).alias("__name")).distinct(), "__name")
    best = there.groupBy(item).agg(F.min_by("__name", "__rank").alias("found"))
    return items.join(best, item)


def candidate_names(stem_column: Column, patterns: Sequence[str]) -> list[Column]:
    def one(pattern: str) -> Column:
        before, _, after = pattern.partition("{stem}")
        return F.concat(F.lit(before), stem_column, F.lit(after))

    return [one(p) for p in patterns]


def keep_listed(items: DataFrame, listed: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Items whose key is listed; with ``strict`` an empty result raises NoPairs."""
    out = items.join(listed.select(key).distinct(), key, "left_semi")
    if strict and out.isEmpty():
        raise NoPairs(f"no row is listed by {key}")
    return out


def missing(items: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Items without a stored row: what a cache has yet to compute."""
    return items.join(stored.select(key).distinct(), key, "left_anti")


def seen_pairs(models: DataFrame, domains: DataFrame) -> DataFrame:
    """(t, i) of every model with the domains it has seen; both sides have a row a domain."""
    return models.select("t").join(F.broadcast(domains.select("i")), F.col("i") <= F.col("t"))
