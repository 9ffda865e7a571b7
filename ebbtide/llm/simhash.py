"""SimHash near-duplicates by vantage-point trees.

Fingerprints are 64-bit SimHashes of 3-word shingles. A departure from the plain form
of the method: the trees are not over all 64 bits. A single tree over 64 bits with
radius 3 is exact too, but random fingerprints lie so close to every median sphere
that three branches in four survive the triangle bound. Two distinct fingerprints
that differ in at most 3 bits differ in at most 1 bit on one of their 32-bit halves,
so a forest of two vantage-point trees, one over each half with Hamming distance as
its metric, is searched with radius 1 (about one branch in seven survives) and finds
every pair; the full 64 bits are then compared exactly.

The upper levels of each tree are fitted on a sample bounded by the number of shards
(``SAMPLE_A_SHARD``, at most ``MOST_SAMPLED`` in all) and only deal fingerprints to
shards, as many as the rows need; each fingerprint has one home shard, and one within
the radius outside a sphere also visits the shards inside it. Every shard goes on
splitting in memory and compares its leaves. Fingerprints that no sphere divides,
since their halves coincide, differ in at most 3 bits of the other half: its bits are
cut into six blocks, of which a linked pair shares three, so that only rows that share
three blocks are compared, and a shard that would hold far more rows than others is
dealt by those blocks to many tasks. Only a spanning forest of the links leaves a
shard, never all pairs of a group; components come from distributed label propagation
with pointer jumping over tables in the shared folder.

Defined cases: null and empty texts, and texts without words, have fingerprint
zero, linked like any other; texts are read whole, long ones in pieces, so that
memory holds no more than the text itself; repeated rows, and copies of any number,
share one fingerprint and are linked once; an empty table gives an empty result;
other columns are not read. A null doc_id never names a component that holds another
id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.sampling import hash_sample
from ._common import Scratch, arrow_map, as_bytes, bounded_batches, table

SHINGLE = 3
SEED = 42
LINK_BITS = 3
HALF_RADIUS = LINK_BITS // 2
SHARD_ROWS = 20_000
HOT_SHARDS = 4  # times the rows of a shard, from where it is dealt by blocks
SAMPLE_ROWS = 8_192
SAMPLE_A_SHARD = 16
MOST_SAMPLED = 1 << 18
LEAF_ROWS = 512
BLOCKS, SHARED_BLOCKS = 6, 3  # three bits spoil three blocks at most
DROPPED_BROADCAST = 500_000  # row numbers of 8 bytes
_BLOCK_WORDS = 200_000
_PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _long_fingerprint(text: bytes) -> int:
    """Of one text, a piece at a time: the last words of a piece go on into the next."""
    counts, total, at, words = np.zeros(64, np.int64), 0, 0, []
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE_BYTES)
        end = cut.start() if cut else len(text)
        words += text[at:end].lower().split()
        if len(words) >= SHINGLE:
            shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
            counts += _bits(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))).sum(axis=0, dtype=np.int64)
            total += len(shingles)
            words = words[1 - SHINGLE :]
        at = end
    if total == 0:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each UTF-8 text, as unsigned 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    at = 0
    while at < len(texts):
        if len(texts[at]) > _PIECE_BYTES:
            out[at] = _long_fingerprint(texts[at])
            at += 1
            continue
        hashes, lengths, begin = [], [], at
        words_seen = 0
        while at < len(texts) and len(texts[at]) <= _PIECE_BYTES and (words_seen == 0 or words_seen < _BLOCK_WORDS):
            w = texts[at].lower().split()
            shingles = list(map(b" ".join, zip(w, w[1:], w[2:]))) if len(w) >= SHINGLE else [b" ".join(w)] if w else []
            hashes.append(shingles)
            lengths.append(len(shingles))
            words_seen += len(w)
            at += 1
        sizes = np.array(lengths, np.int64)
        digest, seeds = xxhash.xxh64_intdigest, [SEED] * int(sizes.sum())
        values = np.fromiter(map(digest, chain.from_iterable(hashes), seeds), np.uint64, len(seeds))
        some = np.flatnonzero(sizes)
        if len(some) == 0:
            continue
        bits = _bits(values)
        ends = np.cumsum(sizes[some])
        for i, start, end in zip(some, ends - sizes[some], ends, strict=True):
            majority = 2 * bits[start:end].sum(axis=0, dtype=np.int64) > end - start
            out[begin + i] = np.packbits(majority, bitorder="little").view("<u8")[0]
    return out


def with_fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and ``fp``, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = fingerprints(as_bytes(batch.column(len(keys)))).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(fps)], names=[*keys, "fp"])

    kept = docs.select(*(F.col(k).cast("long") for k in keys), F.col("text").cast("string"))
    return arrow_map(kept, run, ", ".join(f"{k} long" for k in [*keys, "fp"]))


@dataclass
class Node:
    """A sphere around a vantage point; children are nodes or shard numbers."""

    point: int
    radius: int
    inner: Node | int
    outer: Node | int


def half(fps: np.ndarray, which: int) -> np.ndarray:
    return ((fps >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def choose_sphere(values: np.ndarray, tries: int = 24) -> tuple[int, int] | None:
    """The vantage point and radius that leave least of the values near the sphere, with a fifth or more on either side; None if none divides them."""
    best, found = None, None
    step = max(1, len(values) // tries)
    for point in values[::step][:tries]:
        counts = np.bincount(np.bitwise_count(values ^ point), minlength=34)
        inside = np.cumsum(counts) / len(values)
        for radius in np.flatnonzero((inside >= 0.2) & (inside <= 0.8)):
            near = counts[radius + 1 : radius + 1 + HALF_RADIUS].sum() / len(values)
            cost = near + abs(inside[radius] - 0.5)
            if best is None or cost < best:
                best, found = cost, (int(point), int(radius))
    return found


def fit_tree(sample: np.ndarray, depth: int) -> tuple[Node | int, list[float]]:
    """A tree of at most ``depth`` levels, and the share of the sample in each of its shards."""
    shards: list[float] = []

    def grow(values: np.ndarray, left: int) -> Node | int:
        sphere = choose_sphere(values) if left and len(values) >= 8 else None
        if sphere is None:
            shards.append(len(values) / max(1, len(sample)))
            return len(shards) - 1
        inside = np.bitwise_count(values ^ np.uint32(sphere[0])) <= sphere[1]
        return Node(*sphere, grow(values[inside], left - 1), grow(values[~inside], left - 1))

    return grow(sample, depth), shards


def route(tree: Node | int, values: np.ndarray, home: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows, home): each row's home shard and those it visits; rows that come with ``home`` false only visit.

    Of a pair split by a sphere, the outer row visits the inside, so inner rows
    need not visit the outside; a visitor goes wherever the triangle bound lets
    a partner be.
    """
    todo = [(tree, np.arange(len(values)), np.ones(len(values), bool) if home is None else home)]
    while todo:
        node, rows, home = todo.pop()
        if len(rows) == 0:
            continue
        if isinstance(node, int):
            yield node, rows, home
            continue
        apart = np.bitwise_count(values[rows] ^ np.uint32(node.point)).astype(np.int16)
        inside = apart <= node.radius
        inner = inside | (apart - HALF_RADIUS <= node.radius)
        outer = ~inside | (~home & (apart + HALF_RADIUS > node.radius))
        todo.append((node.inner, rows[inner], home[inner] & inside[inner]))
        todo.append((node.outer, rows[outer], home[outer] & ~inside[outer]))


def _join_leaf(fps: np.ndarray, at: np.ndarray, visitors: np.ndarray, label: np.ndarray) -> None:
    """Unite the labels of rows linked among ``at``, and between ``visitors`` and ``at``."""
    mine = fps[at]
    step = max(1, (1 << 21) // max(1, len(at)))
    for rows in (at, visitors):
        for i in range(0, len(rows), step):
            block = rows[i : i + step]
            hit = np.bitwise_count(fps[block][:, None] ^ mine[None, :]) <= LINK_BITS
            if rows is at:
                hit[np.arange(len(block)), np.arange(i, i + len(block))] = False
            for r in np.flatnonzero(hit.any(axis=1)):
                _unite(label, int(block[r]), at[hit[r]])


def _root(label: np.ndarray, i: int) -> int:
    while label[i] != i:
        label[i] = label[label[i]]
        i = int(label[i])
    return i


def _unite(label: np.ndarray, i: int, others: np.ndarray) -> None:
    """Union by smallest index; ``others`` are jumped towards their roots together."""
    up = label[others]
    while True:
        over = label[up]
        if (over == up).all():
            break
        up = over
    top = min(_root(label, i), int(up.min()))
    label[_root(label, i)] = top
    label[np.unique(up)] = top
    label[others] = top


def _unite_pairs(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite many pairs at once; every label points to a root before and after."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not ((up := label[label]) == label).all():
            label[:] = up


@cache
def _choices() -> list[tuple[int, ...]]:
    return list(combinations(range(BLOCKS), SHARED_BLOCKS))


def block_masks(bits: list[int]) -> list[int]:
    """For every choice of ``SHARED_BLOCKS`` of the blocks that these bits are cut into, the bits of those."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), BLOCKS)]
    return [sum(blocks[k] for k in choice) for choice in _choices()]


def other_half_masks(which: int) -> list[int]:
    """Of the half that a tree does not look at."""
    first = 32 * (1 - which)
    return block_masks(list(range(first, first + 32)))


GROUP_BITS = 20


def hot_shards(shard: int, which: int, choice: int, groups: np.ndarray) -> np.ndarray:
    """Negative shard numbers of a hot shard's groups."""
    return -1 - (((2 * shard + which) * len(_choices()) + choice << GROUP_BITS) | groups)


def hot_choice(number: int) -> tuple[int, int]:
    """(half, choice of blocks) of a hot shard's group."""
    code = -1 - number >> GROUP_BITS
    return code // len(_choices()) & 1, code % len(_choices())


def join_by_blocks(fps: np.ndarray, at: np.ndarray, label: np.ndarray) -> None:
    """Unite the labels of all linked rows of ``at``, by the bits in which they differ at all."""
    while not ((up := label[label]) == label).all():
        label[:] = up
    mine = fps[at]
    differ = int(np.bitwise_or.reduce(mine ^ mine[0]))
    bits = [b for b in range(64) if differ >> b & 1]
    for mask in block_masks(bits) if len(bits) >= BLOCKS else [0]:
        _join_equal(fps, at, mask, label)


def _join_equal(fps: np.ndarray, at: np.ndarray, mask: int, label: np.ndarray) -> None:
    """Unite the labels of linked rows that agree on the bits of ``mask``; labels point to roots."""
    mine = fps[at]
    key = mine & np.uint64(mask)
    order = np.argsort(key, kind="stable")
    key, rows = key[order], mine[order]
    same = np.flatnonzero(key[1:] == key[:-1])  # starts of pairs at distance 1
    far = 1
    while len(same):
        near = same[np.bitwise_count(rows[same] ^ rows[same + far]) <= LINK_BITS]
        _unite_pairs(label, at[order[near]], at[order[near + far]])
        far += 1
        same = same[same + far < len(key)]
        same = same[key[same] == key[same + far]]


def link_shard(fps: np.ndarray, home: np.ndarray, which: int) -> np.ndarray:
    """For each row, the index of the representative of its links within this shard."""
    values, label = half(fps, which), np.arange(len(fps))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        mine, visitors = todo.pop()
        sphere = choose_sphere(values[mine], 8) if len(mine) > LEAF_ROWS else None
        if sphere is None:
            if len(mine) > LEAF_ROWS:
                join_by_blocks(fps, np.concatenate([mine, visitors]), label)
            elif len(mine) > 1 or len(visitors):
                _join_leaf(fps, mine, visitors, label)
            continue
        rows = np.concatenate([mine, visitors])
        for _, some, at_home in route(Node(*sphere, 0, 1), values[rows], np.arange(len(rows)) < len(mine)):
            todo.append((rows[some[at_home]], rows[some[~at_home]]))
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the shards in one partition; rows come sorted by shard."""
    shard, parts = None, []

    def close() -> pa.RecordBatch:
        fps = np.concatenate([p[0] for p in parts]).view(np.uint64)
        home = np.concatenate([p[1] for p in parts])
        if shard < 0:  # rows of a hot shard, those together that share a choice of blocks
            label, (which, choice) = np.arange(len(fps)), hot_choice(shard)
            _join_equal(fps, label.copy(), other_half_masks(which)[choice], label)
        else:
            label = link_shard(fps, home, shard & 1)
        tied = np.flatnonzero((label != np.arange(len(fps))) & (fps != fps[label]))
        return pa.RecordBatch.from_arrays([pa.array(fps[tied].view(np.int64)), pa.array(fps[label[tied]].view(np.int64))], names=["a", "b"])

    for batch in batches:
        shards, fps, homes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if shard is not None and shards[start] != shard:
                yield close()
                parts = []
            shard = int(shards[start])
            parts.append((fps[start:end].astype(np.int64), homes[start:end].astype(bool)))
    if parts:
        yield close()


def near_links(distinct: DataFrame, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within 3 bits."""
    spark, rows = distinct.sparkSession, distinct.count()
    depth = int(np.ceil(np.log2(max(1, rows / shard_rows))))
    picked = hash_sample(distinct.select("fp"), ["fp"], min(MOST_SAMPLED, max(sample_rows, SAMPLE_A_SHARD << depth)), rows).collect()
    sample = np.array([r["fp"] for r in picked], np.int64).view(np.uint64)
    fitted = [fit_tree(half(sample, w), depth) for w in (0, 1)]
    trees = [t for t, _ in fitted]
    # hot shards, with the number of groups that each choice of blocks is dealt to
    hot = [{k: min(1 << GROUP_BITS, int(share * rows // shard_rows)) for k, share in enumerate(shares) if share * rows > HOT_SHARDS * shard_rows} for _, shares in fitted]

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        shards, rows, homes = [], [], []
        for which, tree in enumerate(trees):
            for shard, at, home in route(tree, half(fps.view(np.uint64), which)):
                if shard in hot[which]:
                    own = fps.view(np.uint64)[at]
                    for choice, mask in enumerate(other_half_masks(which)):
                        key = half(own & np.uint64(mask), 1 - which).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                        shards.append(hot_shards(shard, which, choice, (key % np.uint64(hot[which][shard])).astype(np.int64)))
                        rows.append(at)
                        homes.append(home)
                    continue
                shards.append(np.full(len(at), 2 * shard + which, np.int64))
                rows.append(at)
                homes.append(home)
        at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(shards) if shards else at), pa.array(fps[at]), pa.array(np.concatenate(homes) if homes else at.astype(bool))],
            names=["shard", "fp", "home"],
        )

    bounded_batches(spark)
    dealt = arrow_map(distinct.select("fp"), deal, "shard long, fp long, home boolean")
    return dealt.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_links, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so that rounds grow with the logarithm of a chain's length.
    """
    links = scratch.save(links, "links")  # computed once: another run may choose other representatives, and both directions must be of the same links
    both = scratch.save(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels-0")
    number = 0
    while True:
        number += 1
        near = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("at")).agg(F.min("root").alias("low"))
        lower = label.join(near, label["node"] == near["at"]).select("node", F.least("root", "low").alias("root"), F.col("root").alias("was"))
        above = label.select(F.col("node").alias("over"), F.col("root").alias("top"))
        jumped = lower.join(above, lower["root"] == above["over"], "left").select("node", F.least("root", "top").alias("root"), "was")
        found = scratch.save(jumped, f"labels-{number}")
        changed = found.where("root <> was").limit(1).count()
        scratch.drop(f"labels-{number - 1}")
        label = found.select("node", "root")
        if not changed:
            return label


def near_duplicates(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """``fps`` (doc_id, fp, any other key) with ``root``, a fingerprint that names the component, and ``component_id``, the smallest doc_id reachable over links."""
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(distinct), scratch)
    tied = distinct.join(roots, distinct["fp"] == roots["node"])
    lowest = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    renamed = scratch.save(tied.select(F.col("fp").alias("tied_fp"), F.col("root").alias("tied_root")).join(lowest, F.col("tied_root") == lowest["root"]).select("tied_fp", "tied_root", "component_id"), "components")
    linked = F.col("tied_fp").isNotNull()
    named = distinct.join(renamed, distinct["fp"] == renamed["tied_fp"], "left").select(
        F.col("fp").alias("named_fp"), F.when(linked, F.col("tied_root")).otherwise(F.col("fp")).alias("root"), F.when(linked, F.col("component_id")).otherwise(F.col("first")).alias("component_id")
    )
    return fps.join(named, fps["fp"] == named["named_fp"]).drop("named_fp")


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint and component."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.save(with_fingerprints(docs, "doc_id"), "fingerprints")
    return near_duplicates(fps, scratch).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each component left, that of its smallest doc_id (of its repeats, the first read).

    Rows get their number and fingerprint in one pass that is written, so that the
    numbers are the same wherever they are read again.
    """
    scratch, columns = Scratch(docs.sparkSession), docs.columns
    row, mark = (name + "_" * sum(c.startswith(name) for c in columns) for name in ("__row", "__fp"))
    at, numbered = columns.index("text"), docs.withColumn(row, F.monotonically_increasing_id())

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = fingerprints(as_bytes(batch.column(at).cast(pa.string()))).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*columns, row, mark])

    rows = scratch.save(arrow_map(numbered, add, StructType([*numbered.schema.fields, StructField(mark, LongType())])), "rows")
    numbers = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(mark).alias("fp"))
    best = near_duplicates(numbers, scratch).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    kept = scratch.save(best.select(F.col("best.row").alias("kept")), "kept")
    dropped = scratch.save(rows.select(F.col(row).alias("dropped")).join(kept, F.col("dropped") == F.col("kept"), "left_anti"), "dropped")
    # texts stay where they are while the numbers to drop are few enough to send everywhere; beyond, they go through one shuffle by a key without skew
    hint = "broadcast" if dropped.count() <= DROPPED_BROADCAST else "shuffle_hash"
    return rows.join(dropped.hint(hint), rows[row] == dropped["dropped"], "left_anti").select(*columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
