"""Scoring many models in one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .stats import _matrix


def score(
    rows: DataFrame, weights: np.ndarray, keys: Sequence[str], x: str = "x", non_negative: bool = True,
    feature: Callable[[np.ndarray], np.ndarray] | None = None, seen: np.ndarray | None = None, carry: str | None = None,
) -> DataFrame:
    """(keys, model, pred): for every row's keys the summed predictions of each column of ``weights`` (d+1 x models).

    Predictions are clipped row by row before they are summed, within each task and
    then over tasks. Keys are integers. ``seen`` (values of the first key, from 0, x
    models) tells which models a row is wanted for; ``carry`` is a column that is
    summed beside the predictions.
    """
    ship_package(rows.sparkSession)
    kept = rows if seen is None else rows.where(F.col(keys[0]).between(0, len(seen) - 1))
    extra = (F.col(carry) if carry else F.lit(0.0)).cast("double").alias("__carry")
    told = kept.select(*(F.col(k).cast("long").alias(k) for k in keys), extra, F.col(x).cast("array<double>").alias("__x"))
    sums = ["pred"] + ([carry] if carry else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xs = _matrix(batch.column(len(keys) + 1))
            xs = feature(xs) if feature else xs
            out = np.column_stack([xs, np.ones(len(xs))]) @ weights
            out = np.maximum(out, 0.0) if non_negative else out
            marks = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys))])
            groups, at = np.unique(marks, axis=0, return_inverse=True)
            at = at.reshape(-1)
            total = np.zeros((len(groups), weights.shape[1]))
            np.add.at(total, at, out)
            wanted = np.ones(total.shape, bool) if seen is None else seen[groups[:, 0]]
            which, models = np.nonzero(wanted)
            columns = [pa.array(groups[which, k].astype(np.int64)) for k in range(len(keys))]
            columns += [pa.array(models.astype(np.int32)), pa.array(total[which, models])]
            if carry:
                carried = np.bincount(at, batch.column(len(keys)).to_numpy(zero_copy_only=False), len(groups))
                columns.append(pa.array(carried[which]))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "model", *sums])

    schema = "".join(f"{k} long, " for k in keys) + "model int" + "".join(f", `{c}` double" for c in sums)
    return told.mapInArrow(run, schema).groupBy(*keys, "model").agg(*(F.sum(c).alias(c) for c in sums))
