"""Plumbing shared by the corpus operators: shared scratch tables and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import ship_package

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch carries to Python, however long its texts are, and let the executors import this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB")) > limit:
        spark.conf.set(key, str(limit))


_clear: dict[str, Callable[[], None]] = {}
_holder = ""


def holds_memory(module: str, clear: Callable[[], None]) -> None:
    """Tell how to empty a module's caches when a worker turns to another module's work."""
    _clear[module] = clear


def take_worker(module: str) -> None:
    """One module's caches at a time: Python workers go on from stage to stage and would gather them all."""
    global _holder
    if _holder == module:
        return
    _holder = module
    for name, clear in _clear.items():
        if name != module:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc keeps freed memory otherwise
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch."""
    bounded_batches(df.sparkSession)
    module = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(module)
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def without_gc(fn: Callable) -> Callable:
    """``fn`` run with the cycle collector off: large caches make its passes cost more than the work itself."""

    @functools.wraps(fn)
    def run(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return fn(*args)
        finally:
            if on:
                gc.enable()

    return run


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Texts of a string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local master gets a temporary folder of its
    own; a cluster without the setting is an error, since no local folder of the
    driver is seen by its executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="ebbtide-")
    spark.sparkContext.setCheckpointDir(path)
    atexit.register(_remove_local, path[len("file://"):])
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Intermediate Parquet tables in the shared folder; they cut lineage and outlive executors.

    Results read them lazily, so they stay until the interpreter ends, unless
    dropped earlier by the operator that made them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/ebbtide-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        self._remove(f"{self.path}/{name}")

    def _remove(self, path: str) -> None:
        from py4j.protocol import Py4JError

        context = self.spark.sparkContext
        if context._jsc is None:
            return
        try:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except (Py4JError, OSError):
            return  # the session went first; the folder's owner cleans up


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: in ``folder`` if given, else that of the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
