"""Files of a domain, paired with their labels."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import age_in_name, base_name, extension, stem
from ..operators.pairing import IMAGE_SUFFIXES, NYU_LABELS, QNRF_LABELS, SHANGHAI_LABELS, NoPairs, candidate_names, first_candidate, keep_listed, pair_by_stem
from ..operators.sampling import band, in_values
from .configs import include_list

IMAGES = ("jpg", "jpeg", "png")


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path) of every file in a folder, without reading any. A folder that is not there has none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "path string")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).inputFiles()  # empty files too, which a scan leaves out
    return spark.createDataFrame([(unquote(p),) for p in listed], "path string")


def only_images(files: DataFrame, suffixes=IMAGES) -> DataFrame:
    return files.where(extension(F.col("path")).isin(*suffixes))


def first_folder(spark: SparkSession, *folders: str) -> str | None:
    """The first that exists."""
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return folder
    return None


def _strict(pairs: DataFrame, what: str) -> DataFrame:
    if pairs.isEmpty():
        raise NoPairs(f"no pair of image and label: {what}")
    return pairs


def _by_candidates(images: DataFrame, labels: DataFrame, patterns) -> DataFrame:
    """(stem, image, label) by the first label name that is there."""
    named = images.select(F.col("path").alias("image"), stem(F.col("path")).alias("stem"))
    there = labels.select(base_name(F.col("path")).alias("name"), F.col("path").alias("label"))
    found = first_candidate(named, candidate_names(F.col("stem"), patterns), there, item="image")
    return found.join(there, found["found"] == there["name"]).select("stem", "image", "label")


def jhu_pairs(spark: SparkSession, root: str, split: str) -> DataFrame:
    base = f"{root}/{split}"
    labels = list_files(spark, f"{base}/gt").where(extension(F.col("path")) == "txt")
    return _strict(pair_by_stem(only_images(list_files(spark, f"{base}/images")), labels), base)


def shanghai_pairs(spark: SparkSession, root: str, split: str) -> DataFrame:
    base = f"{root}/{'train_data' if split in ('train', 'train_data') else 'test_data'}"
    labels = first_folder(spark, f"{base}/ground-truth", f"{base}/ground_truth") or f"{base}/ground_truth"
    return _strict(_by_candidates(only_images(list_files(spark, f"{base}/images")), list_files(spark, labels), SHANGHAI_LABELS), base)


def qnrf_pairs(spark: SparkSession, root: str, split: str) -> DataFrame:
    base = first_folder(spark, *(f"{root}/{s}" for s in dict.fromkeys((split, split.capitalize(), split.title(), split.upper()))))
    if base is None:
        raise NoPairs(f"no folder of split {split!r} under {root}")
    files = list_files(spark, base)
    return _strict(_by_candidates(only_images(files), files, QNRF_LABELS), base)


COUNTING = {"jhu": jhu_pairs, "shanghai": shanghai_pairs, "shanghaitech": shanghai_pairs, "qnrf": qnrf_pairs, "ucf_qnrf": qnrf_pairs}


def counting_pairs(spark: SparkSession, domain: dict, split: str) -> DataFrame:
    """Pairs of one counting domain, kept to its include list."""
    if domain["kind"] not in COUNTING:
        raise ValueError(f"unknown kind {domain['kind']!r}")
    pairs = COUNTING[domain["kind"]](spark, domain["root"], domain["train_split"] if split == "train" else domain["test_split"])
    listed = include_list(domain, split)
    return keep_listed(pairs, read_include_list(spark, listed), "stem", strict=True) if listed else pairs


def read_include_list(spark: SparkSession, path: str) -> DataFrame:
    """(stem) of each line that is not blank."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line") != "")
    return lines.select(stem(F.col("line")).alias("stem")).distinct()


def age_pairs(spark: SparkSession, domain: dict) -> DataFrame:
    """(path, value) of images whose name holds an age in the domain's band, ends included; by path."""
    files = only_images(list_files(spark, domain["root"], recursive=True)).distinct()
    aged = files.withColumn("value", age_in_name(domain["kind"], F.col("path")))
    return _strict(aged.where(band(F.col("value"), domain["age_min"], domain["age_max"], closed=True)), domain["root"])


def _existing(rows: DataFrame, files: DataFrame, suffixes=("",)) -> DataFrame:
    """Rows (ord, path, value) whose path, with the first suffix that fits, is a file."""
    there = files.select(F.regexp_replace("path", "^file:/+", "/").alias("name"))
    found = first_candidate(rows, [F.concat("path", F.lit(s)) for s in suffixes], there, item="ord")
    return found.select("ord", F.col("found").alias("path"), "value")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; a byte order mark is no part of the first name. ``ord`` is the row's place."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    first = rows.columns[0]
    return rows.withColumnRenamed(first, first.lstrip("﻿")).withColumn("ord", F.monotonically_increasing_id())


def _in_root(root: str, name):
    return F.when(name.startswith("/"), name).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), name))


def score_pairs(spark: SparkSession, domain: dict) -> DataFrame:
    """(ord, path, value) of CSV rows whose score is in [min, max) and whose image is there."""
    rows = _csv(spark, domain["csv"]).select("ord", _in_root(domain["root"], F.trim(domain["img_col"])).alias("path"), F.col(domain["score_col"]).cast("double").alias("value"))
    kept = rows.where(band(F.col("value"), domain["score_min"], domain["score_max"], closed=False))
    return _strict(_existing(kept, list_files(spark, domain["root"], recursive=True)), domain["csv"])


def quality_csv_pairs(spark: SparkSession, domain: dict) -> DataFrame:
    rows = _csv(spark, domain["csv"])
    if domain["filter_val"]:
        rows = rows.where(in_values(F.col(domain["filter_col"]), domain["filter_val"])) if domain["filter_col"] in rows.columns else rows.limit(0)
    told = rows.select("ord", _in_root(domain["root"], F.trim(domain["img_col"])).alias("path"), F.col(domain["mos_col"]).cast("double").alias("value"))
    return _existing(told, list_files(spark, domain["root"], recursive=True), IMAGE_SUFFIXES)


def quality_tid_pairs(spark: SparkSession, domain: dict) -> DataFrame:
    """Lines "score name" beside a folder of images."""
    root = domain["root"]
    scores = first_folder(spark, f"{root}/mos_with_names.txt", f"{root}/mos.txt") or f"{root}/mos.txt"
    images = first_folder(spark, f"{root}/distorted_images") or root
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(scores).withColumn("ord", F.monotonically_increasing_id()).where(F.size(parts) >= 2)
    told = lines.select("ord", F.concat(F.lit(images + "/"), parts[1]).alias("path"), parts[0].cast("double").alias("value"))
    return _existing(told, list_files(spark, images))


QUALITY = {"csv": quality_csv_pairs, "tid": quality_tid_pairs}


def quality_pairs(spark: SparkSession, domain: dict) -> DataFrame:
    if domain["kind"] not in QUALITY:
        raise ValueError(f"unknown kind {domain['kind']!r}")
    return QUALITY[domain["kind"]](spark, domain)


def depth_pairs(spark: SparkSession, domain: dict, split: str) -> DataFrame:
    """Pairs of images and depth maps, kept to a split file if that is there."""
    if domain["kind"] != "nyu":
        raise ValueError(f"unknown kind {domain['kind']!r}")
    root = domain["root"]
    nested = first_folder(spark, f"{root}/rgb") is not None
    images = only_images(list_files(spark, f"{root}/rgb" if nested else root), ("png", "jpg"))
    labels = list_files(spark, f"{root}/depth" if nested else root)
    pairs = _by_candidates(images, labels, NYU_LABELS)
    listed = domain["split_file"] if split == "train" else domain["test_split_file"]
    if listed and first_folder(spark, listed):
        stems = spark.read.text(listed).select(F.trim("value").alias("stem")).where("stem <> ''")
        pairs = keep_listed(pairs, stems, "stem")
    return _strict(pairs, root)
