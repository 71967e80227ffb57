import math
import random
import struct

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.functions.geodesic import direct, footprint, geodesic, inverse
from wakeline.operators.raster import footprint_cells, footprint_triangles, line_cells, triangle_cells
from wakeline.schemas import METRES
from wakeline.sources import wkb


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_grid_cell(spark):
    r = one(spark, x=geo.grid_x(F.lit(9.99083572), F.lit(16)), y=geo.grid_y(F.lit(57.01233944), F.lit(16)))
    assert (r.x, r.y) == (34586, 20073)


def bresenham(x1, y1, x2, y2):
    """The usual loop with an error term."""
    dx, dy = abs(x2 - x1), abs(y2 - y1)
    sx, sy = (1 if x2 >= x1 else -1), (1 if y2 >= y1 else -1)
    out, x, y, err = [], x1, y1, (dx if dx > dy else -dy) // 2 if dx > dy else -(dy // 2)
    while True:
        out.append((x, y))
        if (x, y) == (x2, y2):
            return out
        e = err
        if e > -dx:
            err -= dy
            x += sx
        if e < dy:
            err += dx
            y += sy


def test_raster_line(spark):
    ends = [(1, 1, 3, 3), (0, 0, 0, 0), (5, -3, -7, 2), (0, 0, 3, 10), (0, 0, 10, 3), (2, 2, 2, -6)]
    rng = random.Random(1)
    ends += [tuple(rng.randint(-25, 25) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, x1 long, y1 long, x2 long, y2 long")
    got = {}
    for r in line_cells(df, keep=("i",)).collect():
        got.setdefault(r.i, []).append((r.k, r.cell_x, r.cell_y))
    for i, e in enumerate(ends):
        cells = [c[1:] for c in sorted(got[i])]
        assert cells[0] == e[:2] and cells[-1] == e[2:] and cells == bresenham(*e)
    assert [c[1:] for c in sorted(got[0])] == [(1, 1), (2, 2), (3, 3)] and len(got[1]) == 1


def test_geodesic():
    assert inverse(1, 2, 1, 3)[0] == pytest.approx(110576.4165, abs=1e-3)
    assert inverse([1.0], [2.0], [1.0], [2.0])[0] == 0
    x, y = direct(8.0, 56.0, 1.0, 25_000.0)
    metres, azimuth = inverse(8.0, 56.0, x, y)
    assert metres == pytest.approx(25_000, abs=1e-6) and azimuth == pytest.approx(1.0, abs=1e-9)
    assert inverse(0.0, 0.0, 179.9, 0.1)[0] > 1.9e7


def test_geodesics_settle_row_by_row():
    """To the last digits, and the same whatever rows are beside them: a footprint's seconds are cut to whole ones."""
    near, far = (10.011, 55.984, 10.008, 55.983), (0.0, 0.0, 179.0, 0.3)
    alone, beside = (inverse(*zip(near, other)) for other in (near, far))
    assert [v[0] for v in alone] == [v[0] for v in beside]
    assert alone[0][0] == pytest.approx(217.85893293888893, rel=1e-11)
    there = [direct([8.0, 8.0], [56.0, 56.0], [1.0, 1.0], [12.0, metres]) for metres in (12.0, 1.9e7)]
    assert [v[0] for v in there[0]] == [v[0] for v in there[1]]


@settings(max_examples=200, deadline=None)
@given(st.floats(-170, 170), st.floats(-80, 80), st.floats(0, 2 * math.pi), st.floats(0.01, 1e6))
def test_direct_undoes_inverse(x, y, a, d):
    there = direct(x, y, a, d)
    assert inverse(x, y, *there)[0] == pytest.approx(d, rel=1e-6, abs=1e-5)


def test_distances(spark):
    p = [F.lit(float(v)) for v in (1, 2, 1, 3)]
    r = one(spark, h=geo.haversine(*p), e=geo.euclidean(*p, crs=METRES), g=geodesic(*p), null=geodesic(F.lit(None).cast("double"), *p[1:]))
    assert r.h == pytest.approx(6371008.8 * math.pi / 180) and r.e == 1 and r.g == pytest.approx(110576.4165, abs=1e-3) and r.null is None
    with pytest.raises(ValueError):
        geo.haversine(*p, crs=METRES)
    with pytest.raises(ValueError):
        geo.euclidean(*p, crs=4326)


def test_rezoom(spark):
    r = one(spark, a=geo.rezoom(F.lit(-7), F.lit(3), F.lit(2)), b=geo.rezoom(F.lit(7), F.lit(3), F.lit(1)), c=geo.rezoom(F.lit(-3), F.lit(3), F.lit(5)), d=geo.rezoom(F.lit(5), F.lit(3), F.lit(3)))
    assert (r.a, r.b, r.c, r.d) == (-3, 1, -12, 5)


def test_probe_vector(spark):
    dx, dy = geo.probe_vector(F.lit(8.0), F.lit(56.0), F.lit(0.5), F.lit(0.25), F.lit(0.25), *map(F.lit, (8.0, 56.0, 10.0, 56.0, 8.0, 60.0)))
    assert tuple(one(spark, dx=dx, dy=dy)) == (0.5, 1.0)


def test_occupation(spark):
    def seconds(x2, ba, bb, bc):
        ends = spark.createDataFrame([(8.0, 56.0, 0.0, x2, 56.0, 120.0, 1.0, 1.0, 10.0, 10.0)], "x double, y double, m double, x2 double, y2 double, m2 double, a double, b double, c double, d double")
        t = footprint_triangles(ends.withColumn("metres", geodesic("x", "y", "x2", "y2")), ("metres",)).filter("part = 0")
        px, py = geo.from_barycentric(F.lit(ba), F.lit(bb), F.lit(bc), "tx1", "ty1", "tx2", "ty2", "tx3", "ty3")
        begin, end = geo.occupation("m", "m2", "metres", geo.probe_ratio(px, py, "x", "y", "x2", "y2"), "a", "b")
        return t.select(begin.alias("b"), end.alias("e")).first()

    assert seconds(8.005, 0.5, 0.0, 0.5).b == 60
    assert tuple(seconds(8.0, 0.0, 1.0, 0.0)) == (0, 120)


def test_triangle_raster(spark):
    """35 and 40 cells for the two triangles of this line."""
    row = (9.99105250, 57.01534956, 0.0, 9.99096883, 57.01322067, 60.0, 50.0, 50.0, 50.0, 50.0)
    ends = spark.createDataFrame([row], "x double, y double, m double, x2 double, y2 double, m2 double, a double, b double, c double, d double")
    counts = {r["part"]: r["count"] for r in footprint_cells(ends, 20).groupBy("part").count().collect()}
    assert counts == {0: 35, 1: 40}


def test_triangle_without_area(spark):
    t = spark.createDataFrame([(0, 0, 2, 2, 4, 4), (1, 1, 1, 1, 1, 1)], "x1 long, y1 long, x2 long, y2 long, x3 long, y3 long")
    assert triangle_cells(t).count() == 0


def test_footprint_is_beside_the_line(spark):
    df = spark.createDataFrame([(8.0, 56.0, 8.005, 56.0, 10.0, 20.0)], "x double, y double, x2 double, y2 double, c double, d double")
    f = df.select(footprint("x", "y", "x2", "y2", "c", "d").alias("f")).first().f
    assert f.ay > 56 > f.cy and inverse(8.0, 56.0, f.ax, f.ay)[0] == pytest.approx(10) and inverse(8.005, 56.0, f.dx, f.dy)[0] == pytest.approx(20)


def test_wkb(spark):
    assert struct.unpack("<I", wkb.write([(1, 2, 3.5)])[1:5]) == (2001,)
    line = [(1.0, 2.0, 3.0), (4.0, 5.0, 6.5)]
    assert wkb.read_line(wkb.write(line)).tolist() == [list(v) for v in line]
    assert wkb.read_point(wkb.write([(1, 2, 3.5)])).tolist() == [1, 2, 3.5]
    flagged = struct.pack("<BIII", 1, 0x60000002, 4326, 1) + struct.pack("<3d", 1, 2, 3)
    assert wkb.read_line(flagged).tolist() == [[1, 2, 3]]
    big = struct.pack(">BII", 0, 2002, 1) + struct.pack(">3d", 1, 2, 3)
    assert wkb.read_line(big).tolist() == [[1, 2, 3]]
    with_z = struct.pack("<BII", 1, 3002, 1) + struct.pack("<4d", 1, 2, 9, 3)
    assert wkb.read_line(with_z).tolist() == [[1, 2, 3]]
    many = struct.pack("<BII", 1, 2005, 2) + wkb.write(line) + wkb.write(line[::-1])
    assert [v.tolist() for v in wkb.read_lines(many)] == [[list(v) for v in line], [list(v) for v in line[::-1]]]
    for bad in (b"", b"\x05", struct.pack("<BII", 1, 2, 1) + struct.pack("<2d", 1, 2), wkb.write(line)[:-1], struct.pack("<BI", 1, 3)):
        with pytest.raises(wkb.GeometryError):
            wkb.read_line(bad)
    df = spark.createDataFrame([(bytearray(wkb.write(line)),), (None,)], "g binary")
    assert df.select(wkb.to_wkb(wkb.linestring("g")).alias("g")).collect() == df.collect()
    assert spark.createDataFrame([(bytearray(many),)], "g binary").select(F.size(wkb.multilinestring("g"))).first()[0] == 2
    assert tuple(spark.createDataFrame([(bytearray(wkb.write([(1, 2, 3)])),)], "g binary").select(wkb.point("g").alias("p")).first().p) == (1, 2, 3)


def test_linestring_constructors(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, m double").select(geo.coord("x", "y", "m").alias("c"))
    r = df.select(geo.without_measure("c").alias("p"), geo.line("c", "c").alias("l"), geo.valid_linestring(F.array("c")).alias("one"), geo.valid_linestring(F.array("c", "c")).alias("two")).first()
    assert tuple(r.p) == (1, 2) and not r.one and r.two and r.l["from"] == r.l["to"]
    falling = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(2.0).alias("m")), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("m")))
    assert not one(spark, v=geo.valid_linestring(falling)).v
    assert one(spark, v=geo.valid_linestring(F.array().cast("array<struct<x:double,y:double,m:double>>"))).v
