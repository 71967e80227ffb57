"""Tracks and footprints on the cells of Web-Mercator tiles, with the time spent there in nanoseconds.  All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators.segmentation import KEY, ORDER, lines

#: Deepest zoom at which tracks are sampled.
MAX_SAMPLING = 22


def line_cells(rows: DataFrame, x1="x1", y1="y1", x2="x2", y2="y2", keep=()) -> DataFrame:
    """A row for every cell of the raster line of each row: k from 0, n (one less than the cells), cell_x, cell_y."""
    out = rows.withColumn("n", geo.line_cells(x1, y1, x2, y2)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))))
    cx, cy = geo.line_cell("k", x1, y1, x2, y2)
    return out.select(*keep, "n", "k", cx.alias("cell_x"), cy.alias("cell_y"))


def spread(t0: Column, t1: Column, n: Column, k: Column) -> tuple[Column, Column]:
    """Part of [t0, t1] that cell k = 0..n of a line gets: half a step to either side, one nanosecond over, so neighbours touch."""
    dt = geo.div(t1 - t0, n)
    half = geo.div(dt, F.lit(2))
    return F.greatest(t0, t0 + k * dt - half), F.least(t1, t0 + k * dt + half + 1)


def linestring_cells(points: DataFrame, zoom: int, sampling: int, key=KEY, order=ORDER) -> DataFrame:
    """key, x, y, z, t_begin_ns, t_end_ns: cells at `zoom` that a track sampled at min(sampling, 22) passes.  Vertex times are taken in whole
    seconds; a line within one cell of the sampling zoom gives nothing."""
    sampling = min(sampling, MAX_SAMPLING)
    if not 0 <= zoom <= sampling:
        raise ValueError(f"zoom {zoom} is not between 0 and the sampling zoom {sampling}")
    z = F.lit(sampling)
    ends = lines(points, key, order).select(
        *key, geo.grid_x("x", z).alias("x1"), geo.grid_y("y", z).alias("y1"), geo.grid_x("x2", z).alias("x2"), geo.grid_y("y2", z).alias("y2"),
        (F.col("m").cast("bigint") * geo.NS).alias("t0"), (F.col("m2").cast("bigint") * geo.NS).alias("t1"),
    ).filter(geo.line_cells("x1", "y1", "x2", "y2") > 0)
    cells = line_cells(ends, keep=(*key, "t0", "t1"))
    begin, end = spread(F.col("t0"), F.col("t1"), F.col("n"), F.col("k"))
    x, y = (geo.rezoom(c, z, F.lit(zoom)) for c in ("cell_x", "cell_y"))
    return cells.select(*key, x.alias("x"), y.alias("y"), F.lit(zoom).alias("z"), begin.alias("t_begin_ns"), end.alias("t_end_ns"))


def triangle_cells(triangles: DataFrame, keep=()) -> DataFrame:
    """A row for each cell in a triangle with whole-number corners x1..y3 (borders included), with its barycentric alpha, beta, gamma.  A triangle without area gives nothing."""
    left, low, right, high = geo.bounding_box(["x1", "x2", "x3"], ["y1", "y2", "y3"])
    area = geo.triangle_area("x1", "y1", "x2", "y2", "x3", "y3")
    rows = triangles.withColumn("_area", area).filter("_area <> 0")
    rows = rows.withColumns({"_l": left, "_b": low, "_r": right, "_t": high}).withColumn("cell_y", F.explode(F.sequence("_b", "_t")))
    # where the sides cross the row, one cell over to either side: what a thin band has of its box is looked at, not the box
    sides = [(1, 2), (2, 3), (3, 1)]
    across = [F.expr(f"if(cell_y BETWEEN least(y{i}, y{j}) AND greatest(y{i}, y{j}), if(y{i} = y{j}, {end}, x{i} + (cell_y - y{i}) * (x{j} - x{i}) / (y{j} - y{i})), NULL)") for i, j in sides for end in (f"x{i}", f"x{j}")]
    rows = rows.withColumns({"_l": F.greatest("_l", F.floor(F.least(*across)) - 1), "_r": F.least("_r", F.ceil(F.greatest(*across)) + 1)})
    rows = rows.withColumn("cell_x", F.explode(F.sequence("_l", "_r")))
    part = lambda *c: geo.triangle_area(*c) / F.col("_area")
    rows = rows.withColumns({
        "alpha": part("cell_x", "cell_y", "x2", "y2", "x3", "y3"),
        "beta": part("cell_x", "cell_y", "x3", "y3", "x1", "y1"),
        "gamma": part("cell_x", "cell_y", "x1", "y1", "x2", "y2"),
    })
    return rows.filter("alpha >= 0 AND beta >= 0 AND gamma >= 0").select(*keep, "cell_x", "cell_y", "alpha", "beta", "gamma")


def footprint_triangles(ends: DataFrame, keep=()) -> DataFrame:
    """Two triangles of each line (x, y, m, x2, y2, m2, metres a, b ahead and astern, c, d to the sides): corners tx1..ty3 in degrees."""
    from wakeline.functions.geodesic import footprint

    rows = ends.withColumn("_f", footprint("x", "y", "x2", "y2", "c", "d"))
    corner = lambda i, p: (F.col(f"_f.{p}x").alias(f"tx{i}"), F.col(f"_f.{p}y").alias(f"ty{i}"))
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), *[c for i, p in enumerate(ps, 1) for c in corner(i, p)]) for k, ps in enumerate((("a", "c", "b"), ("c", "b", "d")))]))
    return rows.withColumn("_t", pair).select(*keep, "x", "y", "m", "x2", "y2", "m2", "a", "b", "_t.*")


def footprint_cells(ends: DataFrame, zoom: int, keep=()) -> DataFrame:
    """Cells that a ship's footprint covers on each line, with the nanoseconds between which it does; `keep` names columns to keep."""
    from wakeline.functions.geodesic import geodesic

    z = F.lit(zoom)
    tri = footprint_triangles(ends.withColumn("_metres", geodesic("x", "y", "x2", "y2")), (*keep, "_metres"))
    grid = {f"g{i}{c}": (geo.grid_x if c == "x" else geo.grid_y)(f"t{c}{i}", z) for i in (1, 2, 3) for c in "xy"}
    tri = tri.withColumns(grid).withColumnsRenamed({"x": "lx", "y": "ly", "x2": "lx2", "y2": "ly2"}).withColumnsRenamed({f"g{i}{c}": f"{c}{i}" for i in (1, 2, 3) for c in "xy"})
    cells = triangle_cells(tri, [c for c in tri.columns if c not in ("x1", "y1", "x2", "y2", "x3", "y3")])
    px, py = geo.from_barycentric("alpha", "beta", "gamma", "tx1", "ty1", "tx2", "ty2", "tx3", "ty3")
    ratio = geo.probe_ratio(px, py, "lx", "ly", "lx2", "ly2")
    begin, end = geo.occupation("m", "m2", "_metres", ratio, "a", "b")
    return cells.select(*keep, "part", F.col("cell_x").alias("x"), F.col("cell_y").alias("y"), z.alias("z"), (begin * geo.NS).alias("t_begin_ns"), (end * geo.NS).alias("t_end_ns"))
