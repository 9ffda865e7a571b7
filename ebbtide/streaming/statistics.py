"""Statistics kept up to date by a stream: an extension of the batch operators.

Cells are stored per domain, so a micro-batch only adds; decay is applied on reading.
A batch is written under its own id, and a batch that is replayed after a failure
replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import block_statistics


def keep_statistics(rows: DataFrame, keys: Sequence[str], path: str, checkpoint: str, x: str = "x", y: str = "y", once: bool = True) -> StreamingQuery:
    """Add every micro-batch's cells to the table at ``path``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        block_statistics(batch, keys, x, y).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_statistics(spark, path: str, keys: Sequence[str]) -> DataFrame:
    """The cells of all batches so far."""
    return spark.read.parquet(path).groupBy(*keys, "kind", "i", "j").agg(F.sum("v").alias("v"))


def windowed_means(events: DataFrame, time: str, value: str, window: str = "1 day", late: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """Count and mean per event-time window; rows later than the watermark are left out by a stream."""
    told = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    grouped = told.groupBy(F.window("__at", window).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), *keys, "n", "mean")
