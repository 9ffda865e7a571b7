"""A synthetic sequence of drifting domains, each split drawn by one seeded generator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package

SCHEMA = "domain_id int, split string, sample_id long, ord long, patch_id int, x array<double>, y double"


def drifting_domains(spark: SparkSession, domains: int = 4, width: int = 48, patches: int = 64, images: int = 40, drift: float = 1.5, seed: int = 0) -> DataFrame:
    """Patch rows of all domains; targets are rounded, non-negative counts."""
    ship_package(spark)
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, width) / np.sqrt(width)
    turns = [rng.normal(0, 1, width) / np.sqrt(width) for _ in range(domains)]
    centres = [rng.normal(0, 0.6, width) for _ in range(domains)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                domain, test = divmod(number, 2)
                own = np.random.default_rng((2 if test else 1) * 1000 + domain)
                w = base + drift * (domain / max(1, domains - 1)) * turns[domain]
                for image in range(max(10, images // 4) if test else images):
                    x = own.normal(centres[domain], 1.0, size=(patches, width))
                    y = np.clip(np.round(x @ w + 2.0 + own.normal(0, 0.4, patches)), 0, None)
                    n = patches
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([domain] * n, pa.int32()), pa.array(["test" if test else "train"] * n), pa.array([number * 1_000_000 + image] * n, pa.int64()),
                            pa.array([image] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y),
                        ],
                        names=["domain_id", "split", "sample_id", "ord", "patch_id", "x", "y"],
                    )

    return spark.range(0, 2 * domains, 1, 2 * domains).mapInArrow(run, SCHEMA)
