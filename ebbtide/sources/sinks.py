"""Results written out: JSON, CSV and Markdown reports, appended rows, lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of the report.
REPORT = ("setting", "patch_target", "forget", "alpha_patch", "final_avg_MAE", "nBwT", "oldest_MAE", "newest_MAE")


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a row; what was not evaluated is null, never NaN."""
    doubles = {c: F.nanvl(c, F.lit(None).cast(t)) for c, t in rows.dtypes if t in ("double", "float")}
    (rows.withColumns(doubles) if doubles else rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def nest(rows: DataFrame, keys: Sequence[str], value: str = "results") -> DataFrame:
    """(keys, value) with the other columns as an array of structs."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(value))


def report(rows: DataFrame) -> DataFrame:
    """The report's columns, best final average first."""
    return rows.select(*REPORT).orderBy("final_avg_MAE", "setting")


def write_report(rows: DataFrame, path: str) -> None:
    report(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, lines: int = 20) -> str:
    """The first rows of the report as a Markdown table: a top-k by contract."""
    table = ["| " + " | ".join(REPORT) + " |", "|" + "---|" * len(REPORT)]
    for r in report(rows).limit(lines).collect():
        table.append("| " + " | ".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(table) + "\n"


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows to a CSV table that stays one file with one header; for results of a row a run, since the file is rewritten.

    The new file is written beside the table and takes its place in one move; columns must be those of the table.
    """
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    where, beside, before = (hadoop(path.rstrip("/") + end) for end in ("", "__next", "__before"))
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where) and files.exists(before):  # a run ended between the two moves
        files.rename(before, where)
    text = rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns))
    if files.exists(where):
        text = spark.read.option("header", True).csv(str(where)).select(*rows.columns).unionByName(text)
    text.coalesce(1).write.mode("overwrite").option("header", True).csv(str(beside))
    if files.exists(where):
        files.delete(before, True)
        files.rename(where, before)
    files.rename(beside, where)
    files.delete(before, True)


def text_table(rows: DataFrame, lines: int = 40) -> str:
    """The first rows as aligned text for a console; what was not evaluated is a dot."""
    def cell(v: object) -> str:
        if v is None or v != v:
            return "."
        return f"{v:.4g}" if isinstance(v, float) else "[" + ", ".join(map(cell, v)) + "]" if isinstance(v, list) else str(v)

    told = [rows.columns, *([cell(v) for v in r] for r in rows.limit(lines).collect())]
    widths = [max(map(len, c)) for c in zip(*told, strict=True)]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in told) + "\n"


def write_lists(rows: DataFrame, path: str, keys: Sequence[str], value: str = "stem") -> None:
    """A folder of text lists for each combination of keys."""
    rows.select(*keys, value).write.mode("overwrite").partitionBy(*keys).text(path)


def domain_config(names: Sequence[str], root: str, folder: str) -> dict:
    """A counting configuration whose domains are include lists in ``folder``; its keys are fixed values."""
    common = {"kind": "jhu", "root": root, "train_split": "train", "test_split": "train"}
    lists = lambda n: {f"{s}_include_file": f"{folder}/{n}_{s}.txt" for s in ("train", "test")}
    return {"domains": [{"name": n, **common, **lists(n)} for n in names]}
