"""File names: stems, extensions, ages in names, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGE_FIELDS = {"utkface": 1, "agedb": 3}  # 1-based, between underscores


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]*)$", 1))


def age_in_name(kind: str, path: Column) -> Column:
    """The age that a file name of this kind holds; null if it holds none."""
    if kind not in AGE_FIELDS:
        return F.lit(None).cast("double")
    return F.split_part(stem(path), F.lit("_"), F.lit(AGE_FIELDS[kind])).try_cast("double")


def flat_key(path: Column, backbone: str, size: int) -> Column:
    """A cache key that keeps the path readable."""
    return F.concat(F.lit(f"{backbone}_img{size}_"), F.replace(F.replace(path, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("")), F.lit(".npy"))


def digest_key(path: Column, backbone: str, size: int) -> Column:
    return F.md5(F.concat(path, F.lit(backbone), F.lit(str(size))))
