"""Depth maps from PNG files, and feature extraction as an injected function."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.grids import depth_to_cells
from ..session import ship_package

SIGNATURE = b"\x89PNG\r\n\x1a\n"
MILLIMETRES_ABOVE = 1000.0


class PngError(ValueError):
    """The bytes are no grey PNG of 8 or 16 bits without interlacing."""


def read_grey_png(data: bytes) -> np.ndarray:
    """Pixels of a greyscale PNG, at their full depth."""
    if not data.startswith(SIGNATURE):
        raise PngError("no PNG")
    at, head, body = len(SIGNATURE), None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    if head is None or head[3] != 0 or head[2] not in (8, 16) or head[6]:
        raise PngError(f"unsupported header {head}")
    width, height, bits = head[:3]
    step = bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        out[y] = above = _unfilter(int(raw[y, 0]), raw[y, 1:].astype(np.int64), above, step)
    return out.view(">u2").astype(np.float32) if bits == 16 else out.astype(np.float32)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return (row + above) & 255
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0).reshape(-1) & 255
    out = row.copy()
    for i in range(len(row)):
        left, up, corner = (out[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
        if kind == 3:
            guess = (left + up) // 2
        elif kind == 4:
            near = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(near - v))
        else:
            raise PngError(f"unknown filter {kind}")
        out[i] = (row[i] + guess) & 255
    return out


def to_metres(depth: np.ndarray, max_depth: float) -> np.ndarray:
    """Millimetres, which show by a maximum above 1000, become metres; then the range is clipped."""
    metres = depth / np.float32(1000.0) if depth.size and depth.max() > MILLIMETRES_ABOVE else depth
    return np.clip(metres, 0.0, max_depth)


def read_depth_targets(spark: SparkSession, path: str, max_depth: float, size: int, cells: int) -> DataFrame:
    """(path, y) with the mean depth of each cell of every depth map."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = [depth_to_cells(to_metres(read_grey_png(d), max_depth), size, cells).tolist() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ys, pa.list_(pa.float64()))], names=["path", "y"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, y array<double>")


def extract_features(files: DataFrame, extractor: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(path, patch_id, x) of files (path, content); ``extractor`` gives the patch vectors of one image, its class token left out."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vectors = np.asarray(extractor(data), float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(vectors)), pa.array(np.arange(len(vectors), dtype=np.int32)), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["path", "patch_id", "x"]
                )

    return files.select("path", "content").mapInArrow(run, "path string, patch_id int, x array<double>")
