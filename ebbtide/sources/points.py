"""Point labels and their counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import cell
from ..session import ship_package
from .matfile import QNRF_KEYS, SHANGHAI_KEYS, MatError, points_of, read_mat


def parse_points(lines: DataFrame, value: str = "value", commas: bool = False) -> DataFrame:
    """The rows with ``px`` and ``py`` of lines with two tokens or more; other lines go."""
    text = F.regexp_replace(value, ",", " ") if commas else F.col(value)
    parts = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")
    return lines.where(F.size(parts) >= 2).withColumns({"px": parts[0].cast("double"), "py": parts[1].cast("double")})


def read_point_files(spark: SparkSession, paths: list[str] | str, commas: bool = False) -> DataFrame:
    """(path, px, py) of text label files."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_points(lines, commas=commas).select("path", "px", "py")


def read_mat_points(spark: SparkSession, path: str, layout: str = "shanghai", skip_bad: bool = False) -> DataFrame:
    """(path, px, py) of MATLAB label files; with ``skip_bad`` files without points are passed over."""
    ship_package(spark)
    keys, nested_first = (SHANGHAI_KEYS, True) if layout == "shanghai" else (QNRF_KEYS, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    points = points_of(read_mat(data), keys, nested_first)
                except MatError:
                    if skip_bad:
                        continue
                    raise
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(points)), pa.array(points[:, 0].copy()), pa.array(points[:, 1].copy())], names=["path", "px", "py"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, px double, py double")


def cell_counts(samples: DataFrame, points: DataFrame, key: str, g: int, size: int = 518) -> DataFrame:
    """(key, patch_id, y) for all g*g cells of every sample (key, width, height), points or none."""
    every = samples.select(key, F.explode(F.sequence(F.lit(0), F.lit(g * g - 1))).alias("patch_id"))
    placed = points.join(samples.select(key, "width", "height"), key).select(key, cell(F.col("px"), F.col("py"), F.col("width"), F.col("height"), g, size).alias("patch_id"))
    counted = placed.groupBy(key, "patch_id").agg(F.count("*").cast("double").alias("y"))
    return every.join(counted, [key, "patch_id"], "left").select(key, "patch_id", F.coalesce("y", F.lit(0.0)).alias("y"))


def lines_with_text(value: Column) -> Column:
    """How many lines are not blank: the count of a label file by its lines."""
    return F.size(F.filter(F.split(value, "\n"), lambda x: F.regexp_like(x, F.lit(r"\S"))))


def lines_with_points(value: Column) -> Column:
    """How many lines hold two tokens or more."""
    return F.size(F.filter(F.split(value, "\n"), lambda x: F.regexp_like(x, F.lit(r"\S\s+\S"))))
