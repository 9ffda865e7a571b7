"""Sufficient statistics of ridge regression, per domain.

Everything that training needs of a domain is R = X'X, C = X'y, y'y, the sum of y and
n, all of which add up over rows. They are kept per domain and never decayed in
place: forgetting is a weight given when they are combined, so one scan serves every
factor, rows may arrive in any order, and late rows of an old domain count as its own.

``long_statistics`` is plain SQL over pairs of components, in one aggregation of one
scan. ``packed_statistics`` sums blocks with matrix products: each task packs what it
has of a key into one vector, cut into slices of ``SLICE`` numbers, and slices are
summed over tasks one at a time, spread over keys and slices. ``block_statistics``
takes the sums apart into the same cells, ``gather_statistics`` brings them to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import with_bias
from ..session import ship_package

CELLS = "kind string, i int, j int, v double"
SLICE = 8_192


@dataclass
class Statistics:
    """R (d x d), C (d), y'y, sum of y, and n of one key."""

    r: np.ndarray
    c: np.ndarray
    yy: float = 0.0
    y: float = 0.0
    n: int = 0

    def scaled(self, s: float) -> Statistics:
        """As if every target had been divided by ``s``."""
        return Statistics(self.r, self.c / s, self.yy / s**2, self.y / s, self.n)

    def __add__(self, other: Statistics) -> Statistics:
        return Statistics(self.r + other.r, self.c + other.c, self.yy + other.yy, self.y + other.y, self.n + other.n)


def long_statistics(rows: DataFrame, keys: Sequence[str], x: str = "x", y: str | Column = "y", bias: bool = True, width: int | None = None) -> DataFrame:
    """(keys, kind, i, j, v): "r" cells with i <= j, "c" cells with j = -1, and "yy", "y", "n".

    With the vectors' ``width`` given, every cell is a sum of its own in one aggregate
    without a row more than it has keys; without it each row is taken apart into its cells.
    """
    vector = F.col(x).cast("array<double>")
    target = (F.col(y) if isinstance(y, str) else y).cast("double")
    told = rows.select(*keys, (with_bias(vector) if bias else vector).alias("__x"), target.alias("__y"))
    cell = lambda kind, i, j, v: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), v.cast("double").alias("v"))
    none, xs, t = F.lit(-1), F.col("__x"), F.col("__y")
    if width is not None:
        d = width + bias
        at = [F.element_at("__x", k + 1) for k in range(d)]
        sums = [("r", i, j, at[i] * at[j]) for i in range(d) for j in range(i, d)] + [("c", i, -1, at[i] * t) for i in range(d)] + [("yy", -1, -1, t * t), ("y", -1, -1, t), ("n", -1, -1, F.lit(1.0))]
        wide = told.groupBy(*keys).agg(*(F.sum(v).alias(f"__{k}") for k, (*_, v) in enumerate(sums)))
        cells = F.array(*(cell(kind, F.lit(i), F.lit(j), F.col(f"__{k}")) for k, (kind, i, j, _) in enumerate(sums)))
        return wide.select(*keys, F.explode(cells).alias("s")).select(*keys, "s.*")
    r = F.flatten(F.transform(xs, lambda a, i: F.transform(F.slice(xs, i + 1, F.size(xs)), lambda b, j: cell("r", i, i + j, a * b))))
    c = F.transform(xs, lambda a, i: cell("c", i, none, a * t))
    one = F.array(*(cell(kind, none, none, v) for kind, v in (("yy", t * t), ("y", t), ("n", F.lit(1.0)))))
    apart = told.select(*keys, F.explode(F.concat(r, c, one)).alias("s")).select(*keys, "s.*")
    return apart.groupBy(*keys, "kind", "i", "j").agg(F.sum("v").alias("v"))


def kept_local(cells: DataFrame) -> DataFrame:
    """Rows whose number is that of cells and keys, not of data: computed once, so that what follows does not scan again."""
    return cells.sparkSession.createDataFrame(cells.toArrow())


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; all must have one length."""
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def packed_statistics(
    rows: DataFrame, keys: Sequence[str], x: str = "x", y: str | Column = "y", bias: bool = True,
    feature: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(keys, __d, __slice, __v): upper triangle of R by rows, C, y'y, sum of y and n, in slices; integer keys.

    ``__d`` is the width of R. ``feature`` maps a block of vectors first.
    """
    ship_package(rows.sparkSession)
    target = (F.col(y) if isinstance(y, str) else y).cast("double")
    told = rows.select(*(F.col(k).cast("long").alias(k) for k in keys), F.col(x).cast("array<double>").alias("__x"), target.alias("__y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ys = _matrix(batch.column(len(keys))), batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            xs = feature(xs) if feature else xs
            xs = np.column_stack([xs, np.ones(len(xs))]) if bias else xs
            marks = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys))]) if keys else np.zeros((len(xs), 0))
            for mark in np.unique(marks, axis=0):
                some = (marks == mark).all(axis=1)
                a, b = xs[some], ys[some]
                add = [a.T @ a, a.T @ b, float(b @ b), float(b.sum()), len(b)]
                key = (*map(int, mark), a.shape[1])
                old = held.get(key)
                held[key] = [p + q for p, q in zip(old, add, strict=True)] if old else add
        for key, (r, c, yy, ysum, n) in held.items():
            packed = np.concatenate([r[np.triu_indices(len(c))], c, [yy, ysum, float(n)]])
            cuts = np.append(np.arange(0, len(packed), SLICE), len(packed)).astype(np.int32)
            parts = len(cuts) - 1
            columns = [pa.array(np.full(parts, k, np.int64)) for k in key[:-1]]
            columns += [pa.array(np.full(parts, key[-1], np.int32)), pa.array(np.arange(parts, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(cuts, packed)], names=[*keys, "__d", "__slice", "__v"])

    schema = "".join(f"{k} long, " for k in keys) + "__d int, __slice int, __v array<double>"
    total = vector_to_array(Summarizer.sum(array_to_vector("__v")))
    return told.mapInArrow(run, schema).groupBy(*keys, "__d", "__slice").agg(total.alias("__v"))


def block_statistics(
    rows: DataFrame, keys: Sequence[str], x: str = "x", y: str | Column = "y", bias: bool = True,
    feature: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """The cells of ``long_statistics`` by matrix products; integer keys. ``feature`` maps a block of vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d, values = row["__d"], np.array(row["__v"])
                i, j = (np.concatenate([t, np.arange(d) if k == 0 else np.full(d, -1), np.full(3, -1)]) for k, t in enumerate(np.triu_indices(d)))
                kinds = np.array(["r"] * (d * (d + 1) // 2) + ["c"] * d + ["yy", "y", "n"])
                at = slice(row["__slice"] * SLICE, row["__slice"] * SLICE + len(values))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(len(values), row[k], np.int64)) for k in keys), pa.array(kinds[at]),
                     pa.array(i[at].astype(np.int32)), pa.array(j[at].astype(np.int32)), pa.array(values)],
                    names=[*keys, "kind", "i", "j", "v"],
                )

    return packed_statistics(rows, keys, x, y, bias, feature).mapInArrow(run, "".join(f"{k} long, " for k in keys) + CELLS)


def gather_statistics(
    rows: DataFrame, keys: Sequence[str], x: str = "x", y: str | Column = "y", bias: bool = True,
    feature: Callable[[np.ndarray], np.ndarray] | None = None,
) -> dict[tuple, Statistics]:
    """Statistics by key, on the driver: their size is that of the features and domains, not of the rows."""
    got = packed_statistics(rows, keys, x, y, bias, feature).toArrow().combine_chunks()
    got = got.sort_by([(k, "ascending") for k in (*keys, "__d", "__slice")])
    marks = list(zip(*(got.column(k).to_pylist() for k in (*keys, "__d")), strict=True))
    values = got.column("__v").combine_chunks()
    numbers, ends = values.flatten().to_numpy(), np.cumsum(values.value_lengths().to_numpy())
    out: dict[tuple, Statistics] = {}
    for first in [k for k, m in enumerate(marks) if not k or m != marks[k - 1]]:
        *key, d = marks[first]
        if tuple(key) in out:
            raise ValueError(f"vectors of different lengths: {[len(out[tuple(key)].c), d]}")
        size = d * (d + 1) // 2
        v = numbers[(ends[first - 1] if first else 0) :][: size + d + 3]
        r = np.zeros((d, d))
        i, j = np.triu_indices(d)
        r[i, j] = r[j, i] = v[:size]
        out[tuple(key)] = Statistics(r, v[size : size + d].copy(), float(v[-3]), float(v[-2]), round(float(v[-1])))
    return out


def collect_statistics(cells: DataFrame, keys: Sequence[str]) -> dict[tuple, Statistics]:
    """Statistics by key from a table of cells, on the driver, in one Arrow table."""
    got = cells.toArrow()
    column = {name: got.column(name).to_numpy() for name in [*keys, "i", "j", "v"]}
    kind = got.column("kind").to_numpy(zero_copy_only=False)
    marks = np.column_stack([column[k] for k in keys]) if keys else np.zeros((len(kind), 0))
    every, which = np.unique(marks, axis=0, return_inverse=True)
    out = {}
    for number, key in enumerate(every.tolist()):
        mine = which.reshape(-1) == number
        at = lambda name, mine=mine: np.flatnonzero(mine & (kind == name))
        rs, cs = at("r"), at("c")
        d = len(cs)
        r, c = np.zeros((d, d)), np.zeros(d)
        i, j, v = column["i"][rs], column["j"][rs], column["v"][rs]
        r[i, j] = r[j, i] = v
        c[column["i"][cs]] = column["v"][cs]
        yy, y, n = (float(column["v"][at(name)[0]]) for name in ("yy", "y", "n"))
        out[tuple(key)] = Statistics(r, c, yy, y, round(n))
    return out


def decayed(cells: DataFrame, domain: str, boundaries: DataFrame, factor: float | None = None) -> DataFrame:
    """(t, kind, i, j, v): cells of all domains d <= t, weighted for every boundary t.

    With ``factor`` f the weight is f^(t-d). Without it ``boundaries`` (t, f) gives a
    factor each, and the weight is the product of those of d+1 .. t.
    """
    ends = boundaries.select("t")
    if factor is not None:
        earlier = F.broadcast(boundaries.select(F.col("t").alias("__d")))
        weights = ends.join(earlier, F.col("__d") <= F.col("t")).withColumn("w", F.pow(F.lit(float(factor)), F.col("t") - F.col("__d")))
    else:
        later = boundaries.select(F.col("t").alias("__b"), "f")
        pairs = ends.join(boundaries.select(F.col("t").alias("__d")), F.col("__d") <= F.col("t")).join(later, (F.col("__b") > F.col("__d")) & (F.col("__b") <= F.col("t")), "left")
        weights = pairs.groupBy("t", "__d").agg(F.aggregate(F.collect_list("f"), F.lit(1.0), lambda a, f: a * f).alias("w"))
    joined = cells.join(F.broadcast(weights), F.col(domain) == F.col("__d"))  # a row for each two domains
    return joined.groupBy("t", "kind", "i", "j").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
