"""Geometry on columns: everything here is a built-in expression."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.schemas import DEGREES, METRES

#: Mean earth radius in metres and metres a second in knots (fixed values).
EARTH_RADIUS = 6371008.8
MS_TO_KNOT = 1.94384
NS = 1_000_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def need_crs(crs: int, wanted: int) -> None:
    """Distances hold in one reference system only."""
    if crs != wanted:
        raise ValueError(f"coordinates are in EPSG:{crs}, but this needs EPSG:{wanted}")


def haversine(x1, y1, x2, y2, crs: int = DEGREES) -> Column:
    """Great-circle metres between points in degrees."""
    need_crs(crs, DEGREES)
    a, b = F.radians(col(y1)), F.radians(col(y2))
    dy, dx = b - a, F.radians(col(x2)) - F.radians(col(x1))
    h = F.pow(F.sin(dy / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(dx / 2), F.lit(2.0))
    # rounding may take h past 1; least() would take a NULL for 1
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def euclidean(x1, y1, x2, y2, crs: int = METRES) -> Column:
    need_crs(crs, METRES)
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return F.sqrt(dx * dx + dy * dy)


def coord(x, y, m) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"), col(m).cast("double").alias("m"))


def without_measure(c) -> Column:
    return F.struct(col(c)["x"].alias("x"), col(c)["y"].alias("y"))


def line(start, end) -> Column:
    return F.struct(col(start).alias("from"), col(end).alias("to"))


def valid_linestring(coords) -> Column:
    """Not a single vertex, and measures that never fall; empty is valid."""
    c = col(coords)
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.get(c, i)["m"] < F.get(c, i - 1)["m"])
    return (F.size(c) != 1) & ~F.coalesce(falls, F.lit(False))


def grid_x(lon, zoom) -> Column:
    """Column of the Web-Mercator tile that a longitude in degrees falls in."""
    return F.floor(F.pow(F.lit(2.0), col(zoom)) / (2 * pi) * (pi + F.radians(col(lon)))).cast("bigint")


def grid_y(lat, zoom) -> Column:
    """Row of the tile; latitudes within +-85.05 degrees."""
    return F.floor(F.pow(F.lit(2.0), col(zoom)) / (2 * pi) * (pi - F.log(F.tan(F.lit(pi / 4) + F.radians(col(lat)) / 2)))).cast("bigint")


def div(a, b) -> Column:
    """Integer quotient, truncated towards zero."""
    return F.call_function("div", col(a), col(b))


def rezoom(v, z_from, z_to) -> Column:
    """Cell number at another zoom: coarser ones truncate, finer ones take the first of the cells."""
    two = lambda e: F.pow(F.lit(2.0), e).cast("bigint")
    a, b = col(z_from), col(z_to)
    return F.when(b <= a, div(v, two(F.greatest(a - b, F.lit(0))))).otherwise(col(v) * two(F.greatest(b - a, F.lit(0))))


def point_difference(x1, y1, x2, y2) -> tuple[Column, Column]:
    return col(x1) - col(x2), col(y1) - col(y2)


def line_cells(x1, y1, x2, y2) -> Column:
    """Steps of the raster line between two cells, both ends included: one less than its cells."""
    return F.greatest(F.abs(col(x2) - col(x1)), F.abs(col(y2) - col(y1)))


def line_cell(k, x1, y1, x2, y2) -> tuple[Column, Column]:
    """Cell k = 0..n of the raster line, in closed form.  Along the longer side (y on ties) it takes a step each time, along the
    other it has gone (k * shorter - n div 2 + n - 1) div n steps."""
    k, x1, y1, x2, y2 = map(col, (k, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    ax, ay = F.abs(dx), F.abs(dy)
    n, short = F.greatest(ax, ay), F.least(ax, ay)
    side = F.when(n == 0, F.lit(0)).otherwise(div(k * short - div(n, F.lit(2)) + n - 1, F.greatest(n, F.lit(1))))
    sign = lambda d: F.when(d < 0, -1).otherwise(1)
    wide = ax > ay
    return x1 + sign(dx) * F.when(wide, k).otherwise(side), y1 + sign(dy) * F.when(wide, side).otherwise(k)


def bounding_box(xs: list, ys: list) -> tuple[Column, Column, Column, Column]:
    xs, ys = [col(c) for c in xs], [col(c) for c in ys]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def triangle_area(x1, y1, x2, y2, x3, y3) -> Column:
    """Signed area from integer corners, exact to the half."""
    x1, y1, x2, y2, x3, y3 = (col(c).cast("bigint") for c in (x1, y1, x2, y2, x3, y3))
    return F.lit(0.5) * ((y2 - y1) * (x2 + x1) + (y3 - y2) * (x3 + x2) + (y1 - y3) * (x1 + x3)).cast("double")


def from_barycentric(ba, bb, bc, x1, y1, x2, y2, x3, y3) -> tuple[Column, Column]:
    ba, bb, bc = map(col, (ba, bb, bc))
    return ba * col(x1) + bb * col(x2) + bc * col(x3), ba * col(y1) + bb * col(y2) + bc * col(y3)


def length(x, y) -> Column:
    return F.sqrt(length2(x, y))


def length2(x, y) -> Column:
    return col(x) * col(x) + col(y) * col(y)


def probe_vector(x, y, ba, bb, bc, x1, y1, x2, y2, x3, y3) -> tuple[Column, Column]:
    """From the point (x, y) to the one that has these weights in the triangle."""
    px, py = from_barycentric(ba, bb, bc, x1, y1, x2, y2, x3, y3)
    return px - col(x), py - col(y)


def probe_ratio(px, py, x1, y1, x2, y2) -> Column:
    """Where a point falls along a line, as a part of it; 0 on a line without length; not held to 0..1."""
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    dot = (col(px) - col(x1)) * dx + (col(py) - col(y1)) * dy
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.try_divide(dot, dx * dx + dy * dy))


def truncated(v) -> Column:
    return col(v).cast("bigint")


def probe_second(m1, m2, ratio) -> Column:
    return truncated((col(m2) - col(m1)) * col(ratio)) + truncated(m1)


def occupation(m1, m2, metres, ratio, ahead, astern) -> tuple[Column, Column]:
    """Seconds between which a ship with `ahead` and `astern` metres before and behind its antenna covers the point at `ratio`."""
    at, dm = probe_second(m1, m2, ratio), col(m2) - col(m1)
    flat = col(metres) == 0
    pace = F.try_divide(dm, col(metres))
    return F.when(flat, at).otherwise(at - truncated(pace * col(ahead))), F.when(flat, at + truncated(dm)).otherwise(at + truncated(pace * col(astern)))


def time_share(start, end, n) -> Column:
    """Duration over a count of points; the whole of it for none."""
    d = col(end) - col(start)
    return F.when(col(n) == 0, d).otherwise(div(d, F.greatest(col(n), F.lit(1))))
