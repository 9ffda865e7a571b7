"""Building domains: by count, and by shuffled chunks."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import with_global_rank
from ..sources.sinks import domain_config

BINS = ("low", "mid", "high")


def count_domains(counted: DataFrame, prefix: str = "JHU", test_share: float = 0.3, seed: int = 0) -> DataFrame:
    """(name, split, place, stem, count): tertiles by count, each shuffled and split; one generator goes through the bins.

    Fewer than three samples raise ValueError.
    """
    ranked = with_global_rank(counted.select("stem", "count"), ["count", "stem"])
    first = ranked.select("n").first()
    if first is None or first["n"] < 3:
        raise ValueError("three domains need three samples at least")
    n, spark = first["n"], counted.sparkSession
    edges, generator, rows = (0, n // 3, 2 * n // 3, n), random.Random(seed), []
    for name, low, high in zip(BINS, edges, edges[1:], strict=False):
        order = list(range(low + 1, high + 1))
        generator.shuffle(order)
        tests = max(1, round(len(order) * test_share))
        rows += [(r, f"{prefix}_{name}", "test" if k < tests else "train", k if k < tests else k - tests) for k, r in enumerate(order)]
    drawn = spark.createDataFrame(rows, "rank long, name string, split string, place int")  # a number a sample
    return ranked.join(drawn, "rank").select("name", "split", "place", "stem", "count")


def count_report(domains: DataFrame) -> DataFrame:
    return domains.groupBy("name").agg(F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("train"), F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("test"), F.min("count").alias("low"), F.max("count").alias("high"), F.avg("count").alias("mean"))


def count_config(root: str, folder: str, prefix: str = "JHU") -> dict:
    return domain_config([f"{prefix}_{b}" for b in BINS], root, folder)


def shuffled_chunks(stems: Sequence[str], chunks: int = 3, seed: int = 42, train_share: float = 0.8) -> list[tuple[int, str, str]]:
    """(chunk, split, stem): sorted stems shuffled by a seed and cut evenly; what is left over goes."""
    order = sorted(stems)
    random.Random(seed).shuffle(order)
    size = len(order) // chunks
    cut = int(size * train_share)
    return [(c, "train" if k < cut else "test", order[c * size + k]) for c in range(chunks) for k in range(size)]
