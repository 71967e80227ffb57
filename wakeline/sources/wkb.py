"""Binary geometries: vertices with a measure to and from WKB.

Written are little-endian ISO codes: 2001 for a point and 2002 for a linestring with M.  Read are these, multi-linestrings (2005), the same with Z and M (3001, 3002, 3005; Z is dropped),
and the flagged codes of EWKB with or without a reference system, in either byte order.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.schemas import COORD, COORDS

POINT, LINE, MULTI_LINE = 1, 2, 5
#: Flags of EWKB type codes (fixed values).
_Z, _M, _SRID = 0x80000000, 0x40000000, 0x20000000


class GeometryError(ValueError):
    """Not a geometry of the kind asked for, or without a measure."""


def _head(data: bytes, at: int) -> tuple[str, int, int, int, int]:
    """(byte order, kind, ordinates, place of the measure, where the body starts)"""
    if len(data) < at + 5 or data[at] not in (0, 1):
        raise GeometryError("not WKB")
    end = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{end}I", data, at + 1)
    body, z, m = at + 5, bool(code & _Z), bool(code & _M)
    if code & _SRID:
        body += 4
    code &= 0x0FFFFFFF
    iso, kind = divmod(code, 1000)
    if iso > 3:
        raise GeometryError(f"unknown type {code}")
    z, m = z or iso in (1, 3), m or iso in (2, 3)
    return end, kind, 2 + z + m, (2 + z) if m else -1, body


def _vertices(data: bytes, at: int, n: int, end: str, width: int, measure: int) -> tuple[np.ndarray, int]:
    if measure < 0:
        raise GeometryError("the geometry has no measure")
    if len(data) < at + 8 * n * width:
        raise GeometryError("the geometry is cut short")
    v = np.frombuffer(data, f"{end}f8", n * width, at).reshape(n, width)
    return v[:, [0, 1, measure]].astype(float), at + 8 * n * width


def _line(data: bytes, at: int) -> tuple[np.ndarray, int]:
    end, kind, width, measure, body = _head(data, at)
    if kind != LINE:
        raise GeometryError(f"type {kind} is no linestring")
    (n,) = struct.unpack_from(f"{end}I", data, body)
    return _vertices(data, body + 4, n, end, width, measure)


def read_point(data: bytes) -> np.ndarray:
    end, kind, width, measure, body = _head(data, 0)
    if kind != POINT:
        raise GeometryError(f"type {kind} is no point")
    return _vertices(data, body, 1, end, width, measure)[0][0]


def read_line(data: bytes) -> np.ndarray:
    """Rows of x, y, m."""
    return _line(data, 0)[0]


def read_lines(data: bytes) -> list[np.ndarray]:
    end, kind, _, _, body = _head(data, 0)
    if kind != MULTI_LINE:
        raise GeometryError(f"type {kind} is no multi-linestring")
    (n,) = struct.unpack_from(f"{end}I", data, body)
    out, at = [], body + 4
    for _ in range(n):
        line, at = _line(data, at)
        out.append(line)
    return out


def write(coords) -> bytes:
    """A point for one vertex, else a linestring."""
    v = np.asarray(coords, "<f8").reshape(-1, 3)
    head = struct.pack("<BI", 1, 2001) if len(v) == 1 else struct.pack("<BII", 1, 2002, len(v))
    return head + v.tobytes()


def _structs(v: np.ndarray) -> list[dict]:
    return [{"x": x, "y": y, "m": m} for x, y, m in v.tolist()]


@F.pandas_udf(COORDS)
def _decode(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else _structs(read_line(bytes(b))))


@F.pandas_udf(T.ArrayType(COORDS))
def _decode_multi(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else [_structs(v) for v in read_lines(bytes(b))])


@F.pandas_udf(COORD)
def _decode_point(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None,) * 3 if b is None else read_point(bytes(b)) for b in data], columns=["x", "y", "m"])


@F.pandas_udf(T.BinaryType())
def _encode(coords: pd.Series) -> pd.Series:
    return coords.map(lambda v: None if v is None else write([(c["x"], c["y"], c["m"]) for c in v]))


def linestring(data: Column | str) -> Column:
    """Vertices of a binary linestring; anything else fails."""
    return _decode(data)


def multilinestring(data: Column | str) -> Column:
    return _decode_multi(data)


def point(data: Column | str) -> Column:
    return _decode_point(data)


def to_wkb(coords: Column | str) -> Column:
    return _encode(coords)
