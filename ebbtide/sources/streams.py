"""Experiment rows of a configured domain: pairs, samples, features and targets put together.

A feature extractor is any function from an image's bytes to its patch vectors (class
token left out); features are kept in a table and computed once. Rows are
(domain_id, split, sample_id, ord, patch_id, x, y), ``ord`` the place in the split's stream.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import digest_key
from ..operators.sampling import pick_positions, sample_positions, share_split, with_global_rank
from ..session import ship_package
from . import configs, listings
from .cache import read_through
from .images import extract_features, read_depth_targets
from .points import cell_counts, read_mat_points, read_point_files

Extractor = Callable[[bytes], np.ndarray]
SAMPLE_SEED = 42


def image_size(data: bytes) -> tuple[int, int]:
    """(width, height) from a PNG's or JPEG's header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack_from(">II", data, 16)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + size
    raise ValueError("neither PNG nor JPEG")


def plain(path: Column) -> Column:
    """A local path without its scheme: readers differ in how they write it."""
    return F.regexp_replace(path, "^file:/+", "/")


def by_image(rows: DataFrame, pairs: DataFrame, column: str = "image") -> DataFrame:
    """Rows (path, ..) under the name that ``pairs`` has for the path."""
    names = pairs.select(F.col(column), plain(F.col(column)).alias("__plain")).distinct()
    return rows.join(names, plain(F.col("path")) == F.col("__plain")).drop("path", "__plain")


def read_sizes(files: DataFrame) -> DataFrame:
    """(path, width, height) of files (path, content)."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [image_size(d) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32())], names=["path", "width", "height"])

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int")


def feature_width(rows: DataFrame) -> int:
    """The length of the first vector."""
    found = rows.select(F.size("x").alias("d")).limit(1).collect()
    if not found:
        raise ValueError("no rows")
    return found[0]["d"]


def numbered(pairs: DataFrame, by: str = "image") -> DataFrame:
    """Pairs with ``position`` in the order of a column."""
    return with_global_rank(pairs, [by]).withColumn("position", (F.col("rank") - 1).cast("int")).drop("rank", "n")


def capped(pairs: DataFrame, domain_id: int, most: int | None, seed: int = SAMPLE_SEED) -> DataFrame:
    """At most ``most`` pairs, drawn without repeats by seed and domain, in their order, as ``ord``."""
    n = pairs.count()
    if most is None or n <= most:
        return pairs.withColumn("ord", F.col("position").cast("long"))
    return pick_positions(pairs, sample_positions(n, most, seed + domain_id)).withColumn("ord", F.col("stream_order").cast("long")).drop("stream_order")


def contents(pairs: DataFrame, spark: SparkSession, column: str = "image") -> DataFrame:
    """(path, content) of the files that a column of paths names."""
    paths = [r[column] for r in pairs.select(column).distinct().collect()]  # a path a sample, as the reader is given them
    return spark.read.format("binaryFile").load(paths).select("path", "content") if paths else spark.createDataFrame([], "path string, content binary")


def features(pairs: DataFrame, extractor: Extractor, cache: str, backbone: str, size: int) -> DataFrame:
    """(key, patch_id, x) of the pairs' images, read through the cache."""
    spark = pairs.sparkSession
    asked = pairs.select(F.col("image"), digest_key(F.col("image"), backbone, size).alias("key"))

    def compute(todo: DataFrame) -> DataFrame:
        keyed = todo.select("image", "key")
        return by_image(extract_features(contents(todo, spark), extractor), keyed, "image").join(keyed, "image").select("key", "patch_id", "x")

    return read_through(asked, cache, compute, "key")


def _rows(pairs: DataFrame, vectors: DataFrame, targets: DataFrame, domain_id: int, split: str, backbone: str, size: int) -> DataFrame:
    """Join samples (image, ord), vectors (key, patch_id, x) and targets (image, patch_id, y)."""
    keyed = pairs.select("image", "ord", digest_key(F.col("image"), backbone, size).alias("key"))
    told = keyed.join(vectors, "key").join(targets, ["image", "patch_id"])
    sample = F.lit((domain_id * 2 + (split != "train")) * 10**9).cast("long") + F.col("ord")
    return told.select(F.lit(domain_id).alias("domain_id"), F.lit(split).alias("split"), sample.alias("sample_id"), "ord", F.col("patch_id").cast("int"), "x", "y")


def counting_stream(spark: SparkSession, domain: dict, domain_id: int, split: str, extractor: Extractor, cache: str, cells: int, most: int | None = None, backbone: str = "vit", size: int = 518) -> DataFrame:
    """Patch rows of a counting domain; only the training part is capped."""
    pairs = capped(numbered(listings.counting_pairs(spark, domain, split)), domain_id, most if split == "train" else None)
    labels = [r["label"] for r in pairs.select("label").collect()]
    text, mat = [p for p in labels if p.endswith(".txt")], [p for p in labels if p.endswith(".mat")]
    layout = "qnrf" if "qnrf" in domain["kind"] else "shanghai"
    parts = ([read_point_files(spark, text, commas=domain["kind"] != "jhu")] if text else []) + ([read_mat_points(spark, mat, layout)] if mat else [])
    points = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sizes = by_image(read_sizes(contents(pairs, spark)), pairs)
    labels_of = pairs.select("image", plain(F.col("label")).alias("__label"))
    placed = points.join(labels_of, plain(F.col("path")) == F.col("__label")).select("image", "px", "py")
    targets = cell_counts(sizes, placed, "image", round(cells**0.5), size)
    return _rows(pairs, features(pairs, extractor, cache, backbone, size), targets, domain_id, split, backbone, size)


def depth_stream(spark: SparkSession, domain: dict, domain_id: int, split: str, extractor: Extractor, cache: str, cells: int, most: int | None = None, backbone: str = "vit", size: int = 518) -> DataFrame:
    """Patch rows of a depth domain: mean depth of each cell."""
    pairs = capped(numbered(listings.depth_pairs(spark, domain, split)), domain_id, most if split == "train" else None)
    maps = read_depth_targets(spark, [r["label"] for r in pairs.select("label").collect()], domain["max_depth"], size, cells)
    labelled = by_image(maps, pairs, "label").join(pairs.select("image", "label"), "label")
    targets = labelled.select("image", F.posexplode("y").alias("patch_id", "y"))
    return _rows(pairs, features(pairs, extractor, cache, backbone, size), targets, domain_id, split, backbone, size)


def scalar_stream(spark: SparkSession, kind: str, domain: dict, domain_id: int, split: str, extractor: Extractor, cache: str, most: int | None = None, backbone: str = "vit", size: int = 518) -> DataFrame:
    """Rows of an "age", "scores" or "quality" domain: one mean vector and one value an image."""
    if kind == "age":
        pairs = numbered(listings.age_pairs(spark, domain), "path")
        train, test = share_split(pairs.count(), 0.8, 0, "ages")
        chosen = pick_positions(pairs, (train[:most] if most is not None else train) if split == "train" else test)
    else:
        found = listings.score_pairs(spark, domain) if kind == "scores" else listings.quality_pairs(spark, domain)
        pairs = numbered(found.withColumnRenamed("ord", "line"), "line")
        train, test = share_split(pairs.count(), domain["train_ratio"], domain["split_seed"], kind)
        if most is not None and len(train) > most:
            train = [train[i] for i in sample_positions(len(train), most, SAMPLE_SEED + domain_id)]
        chosen = pick_positions(pairs, train if split == "train" else test)
    chosen = chosen.select(F.col("path").alias("image"), F.col("stream_order").cast("long").alias("ord"), "value")
    pooled = lambda data: np.asarray(extractor(data), float).mean(axis=0, keepdims=True)
    targets = chosen.select("image", F.lit(0).alias("patch_id"), F.col("value").alias("y"))
    return _rows(chosen, features(chosen, pooled, cache, backbone, size), targets, domain_id, split, backbone, size)


def configured_rows(
    spark: SparkSession, path: str, kind: str, extractor: Extractor, cache: str, cells: int, out: str,
    most: int | None = None, backbone: str = "vit", size: int = 518,
) -> DataFrame:
    """Rows of both splits of every domain of a configuration, from a table at ``out`` that is written anew.

    Streams are written one by one: each reads the feature table as it then is, and Spark takes two scans of
    one path for the same even if files came in between.
    """
    domains = configs.read_config(spark, path, kind)
    if kind in configs.KINDS:
        configs.check_kinds(domains, kind)
    mode = "overwrite"
    for r in domains.orderBy("domain_id").collect():  # a row a domain
        domain = r.asDict()
        for split in ("train", "test"):
            if kind in ("counting", "depth"):
                read = counting_stream if kind == "counting" else depth_stream
                rows = read(spark, domain, r["domain_id"], split, extractor, cache, cells, most, backbone, size)
            else:
                rows = scalar_stream(spark, kind, domain, r["domain_id"], split, extractor, cache, most, backbone, size)
            rows.write.mode(mode).parquet(out)
            mode = "append"
    if mode == "overwrite":
        raise ValueError(f"no domains in {path}")
    return spark.read.parquet(out)
