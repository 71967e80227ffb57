"""Geodesics on the WGS84 ellipsoid, vectorised (Vincenty's inverse and direct formulas)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.functions.geo import EARTH_RADIUS, need_crs
from wakeline.schemas import DEGREES

#: Semi-major axis and flattening of WGS84 (fixed values).
A_AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
_B = A_AXIS * (1 - FLATTENING)
#: Rounds of each series that every row gets.  A row that has settled then stays as it is, so its result does not hang on the rows beside it.
INVERSE_ROUNDS, DIRECT_ROUNDS = 8, 6


def _series(cos2_alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u2 = cos2_alpha * (A_AXIS**2 - _B**2) / _B**2
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def _bend(big_b, sin_s, cos_s, cos_2m):
    return big_b * sin_s * (cos_2m + big_b / 4 * (cos_s * (2 * cos_2m**2 - 1) - big_b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))


def inverse(x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray]:
    """Metres and starting azimuth (radians from north) of the shortest way.  Points that nearly face each other, where the series does not
    settle, get the great-circle distance; coincident points distance and azimuth 0."""
    x1, y1, x2, y2 = (np.asarray(v, float) for v in (x1, y1, x2, y2))
    span = np.radians(x2 - x1)
    span = (span + np.pi) % (2 * np.pi) - np.pi
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(y))) for y in (y1, y2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, settled = span.copy(), np.zeros(span.shape, bool)
    with np.errstate(all="ignore"):
        for turn in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * sl / sin_s)
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a == 0, 0.0, cos_s - 2 * s1 * s2 / cos2_a)
            c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
            after = span + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
            settled = (np.abs(after - lam) < 1e-12) & (turn >= INVERSE_ROUNDS)
            if settled.all():
                break
            lam = np.where(settled, lam, after)
        big_a, big_b = _series(cos2_a)
        metres = _B * big_a * (sigma - _bend(big_b, sin_s, cos_s, cos_2m))
        h = np.sin(np.radians(y2 - y1) / 2) ** 2 + np.cos(np.radians(y1)) * np.cos(np.radians(y2)) * np.sin(span / 2) ** 2
        metres = np.where(settled & np.isfinite(metres), metres, 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(1, h))))
        azimuth = np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
    same = (x1 == x2) & (y1 == y2)
    known = np.isfinite(x1 + y1 + x2 + y2)
    return np.where(known, np.where(same, 0.0, metres), np.nan), np.where(same, 0.0, azimuth)


def direct(x, y, azimuth, metres) -> tuple[np.ndarray, np.ndarray]:
    """Point that many metres away in a direction."""
    x, y, azimuth, metres = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, y, azimuth, metres)))
    u1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(y)))
    s1, c1, sa, ca = np.sin(u1), np.cos(u1), np.sin(azimuth), np.cos(azimuth)
    first = np.arctan2(np.tan(u1), ca)
    sin_a = c1 * sa
    cos2_a = 1 - sin_a**2
    big_a, big_b = _series(cos2_a)
    plain = metres / (_B * big_a)
    sigma = plain
    for turn in range(100):
        cos_2m = np.cos(2 * first + sigma)
        after = plain + _bend(big_b, np.sin(sigma), np.cos(sigma), cos_2m)
        done = (np.abs(after - sigma) < 1e-13) & (turn >= DIRECT_ROUNDS)
        if done.all():
            break
        sigma = np.where(done, sigma, after)
    ss, cs, cos_2m = np.sin(sigma), np.cos(sigma), np.cos(2 * first + sigma)
    lat = np.arctan2(s1 * cs + c1 * ss * ca, (1 - FLATTENING) * np.hypot(sin_a, s1 * ss - c1 * cs * ca))
    lam = np.arctan2(ss * sa, c1 * cs - s1 * ss * ca)
    c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
    span = lam - (1 - c) * FLATTENING * sin_a * (sigma + c * ss * (cos_2m + c * cs * (2 * cos_2m**2 - 1)))
    return x + np.degrees(span), np.degrees(lat)


@F.pandas_udf(T.DoubleType())
def _metres(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    return pd.Series(inverse(x1, y1, x2, y2)[0]).where(x1.notna() & x2.notna() & y1.notna() & y2.notna(), None)


def geodesic(x1, y1, x2, y2, crs: int = DEGREES) -> Column:
    """Metres between points in degrees, on the ellipsoid."""
    need_crs(crs, DEGREES)
    return _metres(x1, y1, x2, y2)


def _offset(x, y, dx, dy, metres):
    """The point `metres` away in the direction (dx, dy), in which degrees of longitude and latitude count alike."""
    towards = inverse(x, y, x + dx, y + dy)[1]
    return direct(x, y, towards, metres)


FOOTPRINT = T.StructType([T.StructField(p + c, T.DoubleType()) for p in "abcd" for c in "xy"])


@F.pandas_udf(FOOTPRINT)
def footprint(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Corners of the band that a ship sweeps on a line: start and end offset to the left (a, b) and to the right (c, d).
    Its two triangles are (a, c, b) and (c, b, d).  A line without length has no direction, and all offsets go north."""
    x1, y1, x2, y2, left, right = (v.to_numpy(float) for v in (x1, y1, x2, y2, left, right))
    dx, dy = x2 - x1, y2 - y1
    corners = [_offset(x, y, sx, sy, d) for sx, sy, d in ((-dy, dx, left), (dy, -dx, right)) for x, y in ((x1, y1), (x2, y2))]
    return pd.DataFrame({f"{k}{c}": v for k, xy in zip("abcd", corners) for c, v in zip("xy", xy)})
