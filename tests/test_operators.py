import random

import pytest
from pyspark.sql import functions as F

from wakeline.functions.geo import NS
from wakeline.operators import lookups, ranges, segmentation as seg, stops, tiles
from wakeline.operators.raster import linestring_cells
from wakeline.operators.segmentation import SplitRule

RNG = random.Random(1)


def track(spark, rows, mmsi=1):
    return spark.createDataFrame([(mmsi, i, float(x), float(y), float(m)) for i, (x, y, m) in enumerate(rows)], "mmsi int, pos long, x double, y double, m double")


@pytest.mark.parametrize(("times", "want"), [([0, 1, 2], [3]), ([0, 1, 3, 4], [2, 2]), ([0], [1]), ([0, 5, 5, 9], [1, 2, 1])])
def test_split_by_time(spark, times, want):
    df = track(spark, [(0, 0, t) for t in times])
    got = seg.summaries(seg.segment(df, SplitRule(None, 1.1, op="<="))).orderBy("seg_id").collect()
    assert [r.n_points for r in got] == want


def test_rule():
    for bad in (dict(metres=None, seconds=None), dict(op=">"), dict(metric="x"), dict(combine="xor")):
        with pytest.raises(ValueError):
            SplitRule(**bad)


def test_position_fault(spark):
    """A track whose latitude drops by 40 degrees for a while, and has a gap of time, is cut at each."""
    from wakeline.functions.geodesic import inverse

    rows = [(10 + i / 1000, 55.09 - (40 if 50 <= i < 60 else 0), 1_704_442_450 + 10 * i + (100 if i >= 80 else 0)) for i in range(120)]
    df = seg.segment(track(spark, rows), SplitRule(1000.0, 60.0, op="<="))
    assert [r.n_points for r in seg.summaries(df).orderBy("seg_id").collect()] == [50, 10, 20, 40]
    spans = [(r.t_start_s - 1_704_442_450, r.duration_s) for r in seg.intervals(df).orderBy("seg_id").collect()]
    assert spans == [(0, 490), (500, 90), (600, 190), (900, 390)]
    assert max(float(inverse(a["x"], a["y"], b["x"], b["y"])[0]) for r in seg.pieces(df).collect() for a, b in zip(r.coords, r.coords[1:])) < 1000


def test_pieces_and_concatenation(spark):
    df = seg.segment(track(spark, [(i, 0, m) for i, m in enumerate([0.5, 1, 9, 20, 21.2])]), SplitRule(None, 2))
    parts = seg.pieces(df)
    assert [(r.kind, len(r.coords)) for r in parts.orderBy("seg_id").collect()] == [("sub", 2), ("point", 1), ("sub", 2)]
    assert [(r.t_start_s, r.duration_s) for r in seg.intervals(df).orderBy("seg_id").collect()] == [(0, 1), (9, 0), (20, 2)]
    whole = seg.concatenated(parts).first()
    assert [c["x"] for c in whole.coords] == [0, 1, 2, 3, 4] and whole.valid


@pytest.mark.parametrize("rule", [SplitRule(None, 3, op="<="), SplitRule(900.0, 4, "haversine"), SplitRule(900.0, 2, "haversine", combine="or")])
def test_segments_in_parts(spark, rule):
    rows = []
    for ship in range(4):
        t = RNG.uniform(-50, 50)
        for i in range(80):
            t += RNG.choice([0, 0.5, 1, 2.5, 3, 5, 40])
            rows.append((ship, i, 8 + RNG.uniform(0, 0.02), 56 + RNG.uniform(0, 0.02), t))
    df = spark.createDataFrame(rows, "mmsi int, pos long, x double, y double, m double")
    want = sorted(map(tuple, seg.segment(df, rule).collect()))
    for width in (7, 100, 1e6):
        assert sorted(map(tuple, seg.segment_in_parts(df, rule, width).collect())) == want


def test_violations(spark):
    df = track(spark, [(0, 0, m) for m in (1, 3, 2, 2, 1)])
    assert seg.violations(df).first().n_violations == 2
    assert seg.violations(track(spark, [(0, 0, 1)])).first().n_violations == 1


def test_sweep_is_segmentation(spark):
    df = track(spark, [(RNG.uniform(8, 8.05), RNG.uniform(56, 56.05), i) for i in range(60)])
    assert seg.thresholds() == [4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]
    for r in seg.threshold_sweep(df, [512.0, 1024.0, 2048.0]).collect():
        n = seg.summaries(seg.segment(df, SplitRule(r.threshold, None, "haversine"))).count()
        assert (r.num_splits, r.total_len, r.avg_subtraj_len) == (n, 60, 60 // n)


def test_interval_union(spark):
    rows = [(1000, 2000), (3000, 4000), (5000, 6000), (1500, 3200)]
    df = spark.createDataFrame([(1, a, b) for a, b in rows], "k int, t_begin_ns long, t_end_ns long")
    assert sorted((r.t_begin_ns, r.t_end_ns) for r in tiles.union_intervals(df, ["k"]).collect()) == [(1000, 4000), (5000, 6000)]
    touching = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9)], df.schema)
    assert sorted((r.t_begin_ns, r.t_end_ns) for r in tiles.union_intervals(touching, ["k"]).collect()) == [(0, 7), (9, 9)]


def test_linestring_cells(spark):
    """Nine cells, and no time is lost."""
    rows = [(9.99077490, 57.01199765, 1759393758), (12.59321066, 55.68399700, 1759397358), (8.4437682, 55.4616713, 1759400958), (11.9732157, 57.7093381, 1759404558)]
    cells = linestring_cells(track(spark, rows), 8, 25)
    assert cells.count() == 126239
    merged = tiles.union_intervals(cells, ("mmsi", "x", "y", "z"))
    got = {(r.x, r.y): (r.n, r.s) for r in merged.groupBy("x", "y").agg(F.count("*").alias("n"), (F.sum(F.col("t_end_ns") - F.col("t_begin_ns")) / NS).alias("s")).collect()}
    want = {(134, 79): (1, 936.192), (134, 80): (1, 1706.290), (135, 78): (2, 2371.464), (135, 79): (2, 804.847), (135, 80): (1, 1220.056), (136, 77): (1, 628.530), (136, 78): (1, 109.201), (136, 79): (1, 1611.161), (136, 80): (1, 1412.259)}
    assert set(got) == set(want)
    for k, (n, s) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(s, abs=1e-3)
    assert sum(s for _, s in got.values()) == pytest.approx(10800, abs=1e-6)
    with pytest.raises(ValueError):
        linestring_cells(track(spark, rows), 23, 25)
    still = [(9.99, 57.0, 0), (9.99, 57.0, 60)]
    assert linestring_cells(track(spark, still), 8, 20).count() == 0


def test_combine_tiles(spark):
    nan = float("nan")
    rows = [(1, 1, 8, None, 1, None, 2.0, 4 * NS, 2.0, 2.0, None, None), (1, 1, 8, 6.0, 1, 1.0, None, 6 * NS, 5.0, 5.0, None, 4.0), (1, 2, 8, nan, 1, nan, 3.0, 1, None, None, None, None)]
    schema = "x long, y long, z int, max_draught double, distinct_ship_count long, min_sog double, max_sog double, cell_oc_ns long, min_length double, max_length double, min_width double, max_width double"
    a, b = sorted(tiles.combine(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.y)
    assert tuple(a) == (1, 1, 8, 6.0, 2, 1.0, 2.0, 10 * NS, 2.0, 5.0, None, 4.0)
    assert b.max_draught is None and b.min_sog is None and b.max_sog == 3.0


def test_range_joins(spark):
    spans = [(RNG.randint(1, 3), b := RNG.randint(-50, 200), b + RNG.randint(0, 60), i) for i in range(60)]
    asks = [(RNG.randint(1, 3), b := RNG.randint(-50, 200), b + RNG.randint(0, 60), i) for i in range(60)]
    a = spark.createDataFrame(spans, "mmsi int, b long, e long, i long")
    q = spark.createDataFrame(asks, "mmsi int, f long, t long, q long")
    got = sorted((r.q, r.i) for r in ranges.overlap(q, a, ("f", "t"), ("b", "e"), 25).collect())
    assert got == sorted((x[3], y[3]) for x in asks for y in spans if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    got = sorted((r.q, r.i) for r in ranges.stab(q, a, "f", "b", "e", 25).collect())
    assert got == sorted((x[3], y[3]) for x in asks for y in spans if x[0] == y[0] and y[1] <= x[1] <= y[2])


def test_nav_status(spark):
    df = spark.createDataFrame([("Engaged in fishing",), (None,), ("at anchor",)], "s string")
    assert [r[0] for r in df.select(lookups.nav_status("s")).collect()] == ["EngagedInFishing", None, "AtAnchor"]
    odd = spark.createDataFrame([("Unknown value",)], "s string")
    assert odd.select(lookups.nav_status("s", strict=False)).first()[0] is None
    with pytest.raises(Exception, match="unknown navigational status"):
        odd.select(lookups.nav_status("s")).collect()
    assert len(lookups.NAV_STATUS) == 10


def test_missing_dimensions(spark):
    ships = spark.createDataFrame([(1,), (2,)], "mmsi int")
    dims = spark.createDataFrame([(1, 5.0, 20.0), (1, 6.0, 10.0)], "mmsi int, width double, length double")
    assert sorted(map(tuple, lookups.by_ship(ships, dims, ("length",)).collect()), key=str) == [(1, 6.0, 10.0), (2, None, None)]
    assert lookups.by_ship(ships, dims, ("length",), "inner").count() == 1


POINTS = [(1.5, 2.2), (1.0, 1.1), (1.2, 1.4), (0.8, 1.0), (3.7, 4.0), (3.9, 3.9), (3.6, 4.1), (10, 100)]
CONFIG = stops.StopConfig(3, 1.1, 10, 20, lambda x1, y1, x2, y2: abs(y2 - y1))


def test_cluster_labels():
    x, y = zip(*POINTS)
    label, cluster = stops.label_points(x, y, range(8), [1.0] * 8, CONFIG)
    assert list(label) == ["edge", "core", "core", "core", "core", "core", "core", "noise"]
    assert list(cluster) == [0, 0, 0, 0, 1, 1, 1, -1]
    with pytest.raises(ValueError):
        stops.StopConfig(0)


def plain_labels(rows, config):
    """Straight from the definition, with lists."""
    n = len(rows)
    label, cluster, number = [None] * n, [-1] * n, 0

    def run(i):
        def near(j):
            return rows[j][3] < config.speed and abs(int(rows[j][2]) - int(rows[i][2])) < config.seconds and ((rows[i][0] - rows[j][0]) ** 2 + (rows[i][1] - rows[j][1]) ** 2) ** 0.5 < config.metres

        back, ahead = [], []
        for j in range(i - 1, -1, -1):
            if not near(j):
                break
            back.append(j)
        for j in range(i, n):
            if not near(j):
                break
            ahead.append(j)
        return back + ahead

    for seed in range(n):
        if label[seed]:
            continue
        label[seed], stack, any_core = "noise", [seed], False
        while stack:
            i = stack.pop()
            near = run(i)
            if len(near) < config.min_points:
                continue
            any_core, label[i], cluster[i] = True, "core", number
            for j in near:
                if label[j] == "noise":
                    label[j], cluster[j] = "edge", number
                elif label[j] is None:
                    label[j] = "noise"
                    stack.append(j)
        number += any_core
    return label, cluster


def test_labels_in_pieces(spark):
    """Cutting at gaps changes nothing."""
    config = stops.StopConfig(3, 2.0, 5.0, 3.0, "euclidean")
    rows, want = [], {}
    for ship in range(12):
        t, own = 0.0, []
        for _ in range(60):
            t += RNG.choice([0.4, 1, 2, 4.9, 5, 9])
            own.append((RNG.uniform(0, 4), RNG.uniform(0, 4), t, RNG.uniform(0, 4)))
        label, cluster = plain_labels(own, config)
        for i, (r, a, b) in enumerate(zip(own, label, cluster)):
            rows.append((ship, i, *r))
            want[ship, i] = (a, None if b < 0 else b)
    df = spark.createDataFrame(rows, "mmsi int, pos long, x double, y double, m double, sog double")
    got = {(r.mmsi, r.pos): (r.label, r.cluster_id) for r in stops.label_stops(df, config).collect()}
    assert got == want


def test_stop_parts(spark):
    x, y = zip(*POINTS)
    label, cluster = stops.label_points(x, y, range(8), [1.0] * 8, CONFIG)
    rows = [(1, i, float(a), float(b), float(i), str(k), None if c < 0 else int(c)) for i, ((a, b), k, c) in enumerate(zip(POINTS, label, cluster))]
    parts = stops.stop_parts(spark.createDataFrame(rows, "mmsi int, pos long, x double, y double, m double, label string, cluster_id long"))
    got = parts.orderBy("part_id").collect()
    assert [(r.kind, r.n_points, r.t_start_s, r.t_end_s) for r in got] == [("stop", 4, 0, 3), ("stop", 3, 4, 6), ("move", 1, 7, 7)]
    hulls = stops.stop_hulls(parts)
    assert [len(r.hull) for r in hulls.orderBy("part_id").collect()] == [4, 3]
    assert stops.stop_triangles(hulls).count() == 3


def test_hull_and_triangles():
    for _ in range(50):
        points = [(RNG.random(), RNG.random()) for _ in range(RNG.randint(3, 40))]
        hull = stops.convex_hull(points)
        cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        ring = list(zip(hull, hull[1:] + hull[:1]))
        assert all(cross(a, b, p) >= -1e-12 for a, b in ring for p in points)
        triangles = stops.triangulate(hull)
        assert len(triangles) == len(hull) - 2
        area = sum(abs(cross(*(hull[i] for i in t))) for t in triangles)
        assert area == pytest.approx(sum(a[0] * b[1] - a[1] * b[0] for a, b in ring))
        for t in triangles:  # no corner in any triangle's circle
            (ax, ay), (bx, by), (cx, cy) = (hull[i] for i in t)
            d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
            ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
            uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
            r = ((ax - ux) ** 2 + (ay - uy) ** 2) ** 0.5
            assert all(((p[0] - ux) ** 2 + (p[1] - uy) ** 2) ** 0.5 >= r - 1e-9 for p in hull)
    assert stops.convex_hull([(0, 0), (1, 1), (2, 2)]) == [(0, 0), (2, 2)] and stops.triangulate([(0, 0), (2, 2)]) == []
