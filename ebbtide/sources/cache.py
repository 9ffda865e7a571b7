"""A feature table that is read through: what it lacks is computed and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.pairing import missing


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def read_through(asked: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
    """Stored rows of the keys asked for, after computing and appending those that were missing."""
    spark, have = asked.sparkSession, stored(asked.sparkSession, path)
    todo = asked if have is None else missing(asked, have, key)
    compute(todo.dropDuplicates([key])).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(asked.select(key).distinct(), key, "left_semi")
