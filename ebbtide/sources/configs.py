"""Domain configurations: JSON with a list of domains, whose order is the sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of configuration -> field -> (type, default; None where the field must be given)
FIELDS: dict[str, dict[str, tuple[str, object]]] = {
    "counting": {
        "name": ("string", None), "kind": ("string", "jhu"), "root": ("string", None), "train_split": ("string", "train"), "test_split": ("string", "test"),
        "include_file": ("string", ""), "train_include_file": ("string", ""), "test_include_file": ("string", ""),
    },
    "age": {"name": ("string", None), "kind": ("string", None), "root": ("string", None), "age_min": ("double", 0.0), "age_max": ("double", 200.0)},
    "scores": {
        "name": ("string", None), "root": ("string", None), "csv": ("string", None), "score_min": ("double", 0.0), "score_max": ("double", 10.0),
        "score_col": ("string", "mean_score"), "img_col": ("string", "image_name"), "train_ratio": ("double", 0.8), "split_seed": ("int", 42),
    },
    "depth": {
        "name": ("string", None), "kind": ("string", "nyu"), "root": ("string", None), "split_file": ("string", ""), "test_split_file": ("string", ""),
        "train_split": ("string", "train"), "test_split": ("string", "test"), "max_depth": ("double", 10.0),
    },
    "quality": {
        "name": ("string", None), "kind": ("string", "csv"), "root": ("string", None), "csv": ("string", ""), "img_col": ("string", "image_name"), "mos_col": ("string", "MOS"),
        "filter_col": ("string", ""), "filter_val": ("string", ""), "train_ratio": ("double", 0.8), "split_seed": ("int", 42),
    },
}
#: Kinds with a reader, by kind of configuration.
KINDS = {"counting": ("jhu", "shanghai", "shanghaitech", "qnrf", "ucf_qnrf"), "age": ("utkface", "agedb"), "depth": ("nyu",), "quality": ("csv", "tid")}


def explode_domains(configs: DataFrame, kind: str) -> DataFrame:
    """(domain_id, fields) of rows with an array ``domains``; unknown keys are not there, absent ones get their default."""
    fields = FIELDS[kind]
    told = configs.select(F.posexplode("domains").alias("domain_id", "d"))
    given = told.select("domain_id", *(F.coalesce(F.col("d")[n], F.lit(default)).alias(n) if default is not None else F.col("d")[n].alias(n) for n, (_, default) in fields.items()))
    return given.withColumns({n: F.coalesce(F.col(n), F.raise_error(F.lit(f"a domain has no {n}")).cast(t)) for n, (t, default) in fields.items() if default is None})


def read_config(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in FIELDS:
        raise ValueError(f"unknown configuration {kind!r}; known: {sorted(FIELDS)}")
    inner = ", ".join(f"{n}: {t}" for n, (t, _) in FIELDS[kind].items())
    return explode_domains(spark.read.schema(f"domains array<struct<{inner}>>").json(path, multiLine=True), kind)


def check_kinds(domains: DataFrame, kind: str) -> DataFrame:
    """The domains; a kind without a reader raises ValueError."""
    bad = domains.where(~F.col("kind").isin(*KINDS[kind])).select("name", "kind").take(1)
    if bad:
        raise ValueError(f"domain {bad[0]['name']!r} has kind {bad[0]['kind']!r}; known: {KINDS[kind]}")
    return domains


def include_list(domain: dict, split: str) -> str:
    """The include file that holds for a split: its own if given, else the common one."""
    return domain.get(f"{'train' if split == 'train' else 'test'}_include_file") or domain.get("include_file", "")
