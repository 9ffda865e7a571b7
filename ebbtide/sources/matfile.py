"""Numeric arrays of MATLAB level 5 files (the public format), without other libraries.

Numeric, cell and struct arrays are read, compressed or not, little-endian. A struct
is a dict of its first element's fields, a cell array a list.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np

#: Numeric data types by number.
NUMERIC = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}
MATRIX, COMPRESSED = 14, 15
CELL_CLASS, STRUCT_CLASS = 1, 2
QNRF_KEYS = ("annPoints", "annpoints", "points", "annPoint", "loc")
SHANGHAI_KEYS = ("annPoints", "points", "gt")


class MatError(ValueError):
    """The bytes are no such file, or hold no points."""


def _elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:  # small element: size and data within eight bytes
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def _value(data: bytes):
    parts = list(_elements(data))
    flags = struct.unpack_from("<I", parts[0][1])[0] & 0xFF
    dims = np.frombuffer(parts[1][1], "<i4").tolist()
    name = parts[2][1].decode("latin-1")
    if flags == CELL_CLASS:
        return name, [_value(p)[1] for _, p in parts[3:]]
    if flags == STRUCT_CLASS:
        width = int(np.frombuffer(parts[3][1], "<i4")[0])
        raw = parts[4][1]
        fields = [raw[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(raw), width)]
        return name, dict(zip(fields, (_value(p)[1] for _, p in parts[5 : 5 + len(fields)]), strict=False))
    if len(parts) < 4 or parts[3][0] not in NUMERIC:
        return name, None
    return name, np.frombuffer(parts[3][1], NUMERIC[parts[3][0]]).astype(float).reshape(dims, order="F")


def read_mat(data: bytes) -> dict[str, object]:
    """Variables by name."""
    if len(data) < 128 or data[126:128] != b"IM":
        raise MatError("no little-endian level 5 file")
    out = {}
    for kind, body in _elements(data[128:]):
        if kind == COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body)))
        if kind == MATRIX:
            name, value = _value(body)
            out[name] = value
    return out


def _first_array(value) -> np.ndarray | None:
    """The first numeric array in nested cells and structs."""
    if isinstance(value, np.ndarray):
        return value
    for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        if (found := _first_array(inner)) is not None:
            return found
    return None


def points_of(variables: dict[str, object], keys: Sequence[str], nested_first: bool) -> np.ndarray:
    """N x 2 points: from ``image_info`` or from the first key that is there."""
    nested = _first_array(variables.get("image_info"))
    if nested_first and nested is not None:
        return nested.reshape(-1, 2)
    for key in keys:
        if isinstance(variables.get(key), np.ndarray):
            found = variables[key]
            return found.reshape(-1, found.shape[-1])[:, :2] if found.size else np.zeros((0, 2))
    if nested is not None:
        return nested.reshape(-1, 2)
    raise MatError(f"no points among {sorted(variables)}")
