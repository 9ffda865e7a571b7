"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the exact neighbour graph, a balanced partitioning of it
(recursive halving, then moves that cut fewer edges while parts stay balanced), and
a small softmax classifier from vectors to parts. The parts grow in number with the
table, one for ``PART_ROWS`` rows: where that is more than ``TOP_PARTS``, each of those
is partitioned again in the same way, on a bounded sample of its own rows, and a
vector's probability of a part is the product of both classifiers'. Every row is
indexed under its most probable part.

A query goes to its most probable parts until they hold a share of all rows, where it
is ranked by exact distance. That share is measured, at every size alike: rows of the
sample that are held out of the fit are asked for their exact neighbours within the
sample, and the share is what would have found ``TARGET_RECALL`` of them, with two
standard errors of so many rows added. Clustered vectors need a few parts, vectors
without structure most of them.

A part is split into blocks of about ``BLOCK_ROWS`` rows, so that a part, or one
vector, that holds many of the rows is spread over tasks. Each block is read once, and
its part's queries stream past it; the index is never copied. Each block gives its
nearest and the nearest of those are the result.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component, rows without a vec_id, and vectors whose length is not the commonest (of
ties the smallest) take no part; repeated rows count as candidates each, but not for
a query of their own vec_id, and a query id that repeats is asked once, with its
smallest vector; ties go to the smaller vec_id; with fewer than ``k`` candidates all
are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import hash_sample
from ._common import Scratch, arrow_map, table

K = 10
SAMPLE_ROWS = 8_192  # that the first partitioning is fitted on, and each of the second ones
SAMPLE_BYTES = 64 << 20
GRAPH_NEIGHBOURS = 10
PART_ROWS = 1_024
LEAST_PARTS = 8
TOP_PARTS, SUB_PARTS = 64, 256
SLACK = 1.1
TARGET_RECALL = 0.97
ASKED_ROWS = 1_024  # of the sample, a fifth of it at most
BLOCK_ROWS = 32_768
QUERY_EVERY = 100
SEED = 7


def neighbour_graph(x: np.ndarray, k: int = GRAPH_NEIGHBOURS) -> np.ndarray:
    """Indices of the ``k`` nearest others of each row."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), np.int64)
    if k <= 0:
        return out
    norms = np.einsum("ij,ij->i", x, x)
    for i in range(0, len(x), 512):
        apart = norms[None, :] - 2 * (x[i : i + 512] @ x.T)
        apart[np.arange(len(apart)), np.arange(i, i + len(apart))] = np.inf
        out[i : i + 512] = np.argpartition(apart, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """A part for each row: none much larger than the mean, and few edges between them."""
    rng = np.random.default_rng(SEED)
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:  # halves along the direction in which the rows spread most
        rows, first, count = todo.pop()
        if count == 1 or len(rows) < 2:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        way = rng.standard_normal(x.shape[1])
        for _ in range(10):
            way = centred.T @ (centred @ way)
            way /= np.linalg.norm(way) or 1.0
        left = count // 2
        order = rows[np.argsort(centred @ way, kind="stable")]
        cut = len(rows) * left // count
        todo += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    most = max(1, math.ceil(SLACK * len(x) / parts))
    near = [[] for _ in range(len(x))]
    for i, others in enumerate(graph):
        near[i] += others.tolist()
        for j in others:
            near[j].append(i)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(part[near[i]], minlength=parts)
            votes[size >= most] = -1
            own = int((part[near[i]] == part[i]).sum())
            to = int(votes.argmax())
            if votes[to] > own:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


class Classifier:
    """A softmax classifier from vectors to parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, epochs: int = 40, batch: int = 256, rate: float = 0.01):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        spread = np.sqrt(((x - self.mean) ** 2).mean()) if len(x) else 1.0
        self.scale = spread if np.isfinite(spread) and spread > 0 else 1.0
        rng = np.random.default_rng(SEED)
        self.parts = parts
        z, hot = self._inputs(x), np.eye(parts)[part]
        self.weights = np.zeros((z.shape[1], parts))
        m, v, step = np.zeros_like(self.weights), np.zeros_like(self.weights), 0
        for _ in range(epochs if len(x) else 0):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                slope = z[rows].T @ (self._soft(z[rows]) - hot[rows]) / len(rows) + 1e-4 * self.weights
                step += 1
                m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
                self.weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -1e6, 1e6), np.ones(len(x))])

    def _soft(self, z: np.ndarray) -> np.ndarray:
        s = z @ self.weights
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(self._inputs(x))


def learn_parts(x: np.ndarray, parts: int) -> Classifier:
    """A classifier of the balanced parts of the neighbour graph of ``x``."""
    parts = max(1, min(parts, len(x)))
    return Classifier(x, balanced_parts(x, neighbour_graph(x), parts), parts)


class Router:
    """From vectors to parts: one classifier, or a second one within each of its parts. Parts are numbered through."""

    def __init__(self, top: Classifier, subs: dict[int, Classifier] | None = None):
        self.top, self.subs = top, subs or {}
        counts = [self.subs[p].parts if p in self.subs else 1 for p in range(top.parts)]
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.parts = int(self.first[-1])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        given = self.top.probabilities(x)
        if not self.subs:
            return given
        out = np.repeat(given, np.diff(self.first), axis=1)
        for p, sub in self.subs.items():
            out[:, self.first[p] : self.first[p + 1]] *= sub.probabilities(x)
        return out

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The most probable part within the most probable first part."""
        top = self.top.probabilities(x).argmax(axis=1)
        part = self.first[top]
        for p in np.unique(top):
            if p in self.subs:
                some = top == p
                part[some] += self.subs[p].probabilities(x[some]).argmax(axis=1)
        return part


def probe_share(router: Router, sample: np.ndarray, asked: int, k: int, sizes: np.ndarray) -> float:
    """The share of the rows, by most probable parts, that holds ``TARGET_RECALL`` of the neighbours of the last ``asked`` rows, and two standard errors more."""
    total = max(1, int(sizes.sum()))
    if not asked:
        return 1.0
    part, ids = router.assign(sample), np.arange(len(sample))
    who, found, _ = nearest_in(sample[-asked:], ids, sample, ids[-asked:], k)
    order = np.argsort(-router.probabilities(sample[-asked:]), axis=1, kind="stable")
    before = np.empty(order.shape, np.int64)
    np.put_along_axis(before, order, np.cumsum(sizes[order], axis=1) - sizes[order], axis=1)
    level = min(1.0, TARGET_RECALL + 2 * math.sqrt(TARGET_RECALL * (1 - TARGET_RECALL) / asked))
    return (float(np.quantile(before[who, part[found]], level)) + 1.0) / total


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, whatever their length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda a: a != 0))


def nearest_in(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, distance) of the ``k`` nearest rows of each query, its own id left out.

    A product picks rows near enough to matter, with room for its rounding; their
    distances are then taken exactly.
    """
    norms = np.einsum("ij,ij->i", x, x)
    who, found, apart = [], [], []
    for i in range(0, len(queries), 128):
        block = queries[i : i + 128]
        rough = norms[None, :] - 2 * (block @ x.T) + np.einsum("ij,ij->i", block, block)[:, None]
        rough[own[i : i + 128, None] == ids[None, :]] = np.inf
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(block), np.inf)
        room = 1e-9 * (norms.max() + np.einsum("ij,ij->i", block, block)) + 1e-300
        for q in range(len(block)):
            picked = np.flatnonzero((~(rough[q] > kth[q] + room[q])) & (own[i + q] != ids))
            exact = np.sqrt(np.square(x[picked] - block[q]).sum(axis=1))
            order = np.lexsort([ids[picked], exact])[:k]
            who.append(np.full(len(order), i + q))
            found.append(ids[picked[order]])
            apart.append(exact[order])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(who, np.int64), join(found, np.int64), join(apart, np.float64)


@dataclass
class Index:
    """Rows (vec_id, v, part) in the shared folder, the router that dealt them, each part's rows, and the share of all rows a query looks at."""

    rows: DataFrame
    router: Router
    sizes: np.ndarray
    share: float


def _dealt(rows: DataFrame, router: Router, width: int) -> DataFrame:
    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = router.assign(_matrix(batch.column(1), width))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(part.astype(np.int32))], names=["vec_id", "v", "part"])

    return arrow_map(rows.select("vec_id", "v"), deal, "vec_id long, v array<double>, part int")


def _sizes(indexed: DataFrame, parts: int) -> np.ndarray:
    sizes = np.zeros(parts, np.int64)
    for r in indexed.groupBy("part").count().collect():  # one row per part
        sizes[r["part"]] = r["count"]
    return sizes


def _sub_classifiers(coarse: DataFrame, sizes: np.ndarray, width: int, sample_rows: int) -> dict[int, Classifier]:
    """A classifier for each part of more than ``PART_ROWS`` rows, fitted where a bounded sample of its rows meets."""
    spark = coarse.sparkSession
    shares = [(p, min(1.0, 2 * sample_rows / n)) for p, n in enumerate(sizes.tolist()) if n > PART_ROWS]
    if not shares:
        return {}
    cut = spark.createDataFrame([(p, min(2**63 - 1, int(-(2**63) + share * 2**64))) for p, share in shares], "of int, most long")
    mark = F.xxhash64("vec_id", F.monotonically_increasing_id())
    sampled = coarse.withColumn("mark", mark).join(F.broadcast(cut), F.col("part") == F.col("of")).where(F.col("mark") <= F.col("most"))  # a row a part

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("mark").slice(0, sample_rows)
        part = rows.column("part")[0].as_py()
        parts = min(SUB_PARTS, -(-int(sizes[part]) // PART_ROWS))
        learned = learn_parts(_matrix(rows.column("v").combine_chunks(), width), parts)
        return pa.table({"part": pa.array([part], pa.int32()), "learned": pa.array([pickle.dumps(learned)], pa.binary())})

    fitted = sampled.select("part", "v", "mark").groupBy("part").applyInArrow(fit, "part int, learned binary")
    return {r["part"]: pickle.loads(r["learned"]) for r in fitted.collect()}  # weights of at most TOP_PARTS classifiers, written by fit above


def build_index(rows: DataFrame, width: int, total: int, scratch: Scratch, k: int = K) -> Index:
    """Index ``rows`` (vec_id, v), of which there are ``total``, all of one width."""
    sample_rows = min(SAMPLE_ROWS, max(64, SAMPLE_BYTES // (8 * width)))
    picked = hash_sample(rows, ["vec_id", "v"], sample_rows, total).collect()
    sample = np.array([r["v"] for r in picked], float).reshape(-1, width)
    asked = min(ASKED_ROWS, len(sample) // 5)
    wanted = max(LEAST_PARTS, -(-total // PART_ROWS))
    router = Router(learn_parts(sample[: len(sample) - asked], min(TOP_PARTS, wanted)))
    indexed = scratch.save(_dealt(rows, router, width), "index")
    sizes = _sizes(indexed, router.parts)
    if wanted > TOP_PARTS:
        router = Router(router.top, _sub_classifiers(indexed, sizes, width, sample_rows))
        indexed = scratch.save(_dealt(indexed, router, width), "fine-index")
        sizes = _sizes(indexed, router.parts)
    return Index(indexed, router, sizes, probe_share(router, sample, asked, k, sizes))


def _blocks(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """The nearest rows of each query in each block; rows come sorted, a block's own before its queries."""
    key, ids, vectors = None, [], []
    for batch in batches:
        part, block, asks, names = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3))
        if not len(names):
            continue
        x = _matrix(batch.column(4), width)
        edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
        for start, end in zip([0, *edges], [*edges, len(names)], strict=True):
            if (now := (part[start], block[start])) != key:
                key, ids, vectors = now, [], []
            if not asks[start]:
                ids.append(names[start:end])
                vectors.append(x[start:end])
            elif ids:
                ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                who, found, apart = nearest_in(x[start:end], ids[0], vectors[0], names[start:end], k)
                yield pa.RecordBatch.from_arrays([pa.array(names[start:end][who]), pa.array(found), pa.array(apart)], names=["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose vec_id is divisible by ``query_every`` against all rows."""
    spark = vectors.sparkSession
    scratch, rows = Scratch(spark), usable(vectors)
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    width, total = widths[0]["width"], widths[0]["count"]
    rows = rows.where(F.size("v") == width)
    index = build_index(rows, width, total, scratch, k)
    router, sizes, enough = index.router, index.sizes, index.share * total
    asked = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"), F.count("*").alias("own"))

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = np.argsort(-router.probabilities(_matrix(batch.column(1), width)), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        least = k + batch.column(2).to_numpy()[:, None]  # so that all candidates are found where there are no more
        row, column = np.nonzero((before < np.maximum(enough, least)) & (sizes[order] > 0))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(order[row, column].astype(np.int32))], names=["query_id", "q", "part"])

    probes = arrow_map(asked, probe, "query_id long, q array<double>, part int")
    split = spark.createDataFrame([(p, max(1, -(-int(n) // BLOCK_ROWS))) for p, n in enumerate(sizes)], "of int, blocks int")
    of_part = F.col("part") == F.col("of")  # at most TOP_PARTS * SUB_PARTS rows
    held = index.rows.join(F.broadcast(split), of_part).select(
        "part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v"
    )
    asks = probes.join(F.broadcast(split), of_part).select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("q").alias("v"))
    dealt = held.unionByName(asks).repartition("part", "block").sortWithinPartitions("part", "block", "asks")
    near = dealt.mapInArrow(lambda batches: _blocks(batches, width, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
