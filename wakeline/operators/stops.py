"""Stops of ships: density clustering in the order of time, stop and move parts, their hulls and triangles.

A point's neighbours are the run around it of points that are near to it in space and time and slow; the run ends at the first that is not.  Clusters
grow from cores as in DBSCAN, last found first.  That is sequential, but no run crosses a gap of `seconds` or more, so trajectories are cut there and the pieces are
labelled on their own; a ship's history is never in one task as a whole unless it has no such gap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wakeline.functions.geo import EARTH_RADIUS
from wakeline.functions.geodesic import inverse


def _haversine(x1, y1, x2, y2) -> np.ndarray:
    a, b = np.radians(y1), np.radians(y2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(x2 - x1) / 2) ** 2
    return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(1, h)))


DISTANCES: dict[str, Callable] = {
    "geodesic": lambda x1, y1, x2, y2: inverse(x1, y1, x2, y2)[0],
    "haversine": _haversine,
    "euclidean": lambda x1, y1, x2, y2: np.hypot(x2 - x1, y2 - y1),
}


@dataclass(frozen=True)
class StopConfig:
    """A core has at least `min_points` neighbours, itself included: within `metres`, `seconds` and below `speed`, all strictly."""

    min_points: int = 10
    metres: float = 250.0
    seconds: float = 1800.0
    speed: float = 1.5
    distance: str | Callable = "geodesic"

    def __post_init__(self) -> None:
        if self.min_points < 1:
            raise ValueError("a cluster has at least one point")

    def metric(self) -> Callable:
        return DISTANCES[self.distance] if isinstance(self.distance, str) else self.distance


def _reach(ok: Callable[[np.ndarray], np.ndarray], start: int, stop: int, step: int) -> int:
    """How many of start, start + step, ... before `stop` pass in a row; looked at in growing blocks."""
    n, block = 0, 16
    total = max(0, (stop - start) // step)
    while n < total:
        at = start + step * np.arange(n, min(total, n + block))
        good = ok(at)
        if not good.all():
            return n + int(np.argmin(good))
        n, block = n + len(at), block * 2
    return n


def label_points(x, y, m, sog, config: StopConfig) -> tuple[np.ndarray, np.ndarray]:
    """Label ("core", "edge", "noise") and cluster (-1 for noise) of each point of a trajectory in order."""
    x, y, sog = (np.asarray(v, float) for v in (x, y, sog))
    t = np.trunc(np.asarray(m, float))
    n, far = len(x), config.metric()
    slow = sog < config.speed
    label, cluster = np.full(n, "", object), np.full(n, -1, np.int64)

    def run(i: int) -> tuple[int, int]:
        ok = lambda j: slow[j] & (np.abs(t[j] - t[i]) < config.seconds) & (far(x[i], y[i], x[j], y[j]) < config.metres)
        return i - _reach(ok, i - 1, -1, -1), i + _reach(ok, i, n, 1)

    number = 0
    for seed in range(n):
        if label[seed]:
            continue
        label[seed], stack, grew = "noise", [seed], False
        while stack:
            i = stack.pop()
            low, high = run(i)
            if high - low < config.min_points:
                continue
            grew, label[i], cluster[i] = True, "core", number
            for j in (*range(i - 1, low - 1, -1), *range(i, high)):
                if label[j] == "noise":
                    label[j], cluster[j] = "edge", number
                elif not label[j]:
                    label[j] = "noise"
                    stack.append(j)
        number += grew
    return label, cluster


def label_stops(points: DataFrame, config: StopConfig = StopConfig(), sog: str = "sog") -> DataFrame:
    """Add label and cluster_id (NULL for noise; from 0 for each ship, in order of time) to vertices (mmsi, pos, x, y, m, sog)."""
    w = Window.partitionBy("mmsi").orderBy("m", "pos")
    second = F.col("m").cast("bigint")
    gap = F.coalesce(second - F.lag(second).over(w) >= F.lit(config.seconds), F.lit(False))
    cut = points.withColumn("_cut", gap.cast("int")).withColumn("_piece", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")
    cut = cut.withColumns({f"_{c}": F.col(c).cast("double") for c in ("x", "y", "m")} | {"_s": F.col(sog).cast("double"), "_key": F.xxhash64("mmsi", "_piece")})
    extra = T.StructType([T.StructField("label", T.StringType()), T.StructField("_own", T.LongType()), T.StructField("_n", T.LongType())])
    schema = T.StructType([*cut.schema.fields, *extra.fields])

    def label(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        """Rows of whole pieces, one after the other."""
        rows = pa.Table.from_batches(held)
        edges = np.flatnonzero(np.diff(rows.column("_key").to_numpy(), prepend=0, append=0))
        edges = np.unique(np.concatenate([[0], edges, [rows.num_rows]]))
        columns = [rows.column(c).to_numpy() for c in ("_x", "_y", "_m", "_s")]
        parts = [label_points(*(c[i:j] for c in columns), config) for i, j in zip(edges, edges[1:])]
        own, n = np.concatenate([p[1] for p in parts]), np.zeros(rows.num_rows, np.int64)
        n[edges[:-1]] = [p[1].max() + 1 for p in parts]  # clusters of a piece, at its first row
        for field, values in zip(extra, (np.concatenate([p[0] for p in parts]), own, n)):
            rows = rows.append_column(field.name, pa.array(values, to_arrow_type(field.dataType)))
        return rows.to_batches()

    def run(batches):
        held, last = [], None  # what there is so far of the piece that the last batch may have cut
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("_key").to_numpy()
            if held and key[0] != last:
                yield from label(held)
                held = []
            cuts = np.flatnonzero(np.diff(key)) + 1
            if len(cuts):
                yield from label([*held, b.slice(0, cuts[-1])])
                held, b = [], b.slice(cuts[-1])
            held.append(b)
            last = key[-1]
        if held:
            yield from label(held)

    dealt = cut.repartition("mmsi", "_piece").sortWithinPartitions("mmsi", "_piece", "m", "pos")
    found = dealt.mapInArrow(run, schema)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("mmsi").orderBy("_piece").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = found.withColumn("cluster_id", F.when(F.col("_own") >= 0, F.col("_own") + before))
    return named.select(*points.columns, "label", "cluster_id")


def stop_parts(labelled: DataFrame, order=("m", "pos")) -> DataFrame:
    """Alternating parts of each ship: part_id, kind ('stop' or 'move'), cluster_id, t_start_s, t_end_s, n_points and the vertices in order.
    A stop is a run of points of one cluster, a move a run of noise; a move of one point keeps it."""
    w = Window.partitionBy("mmsi").orderBy(*order)
    own = F.coalesce(F.col("cluster_id"), F.lit(-1))
    new = F.when(F.lag(own).over(w).eqNullSafe(own), 0).otherwise(1)
    rows = labelled.withColumn("_new", new).withColumn("part_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    vertex = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[F.col(c).cast("double").alias(c) for c in "xym"]).alias("v"))
    parts = rows.groupBy("mmsi", "part_id").agg(
        F.first("cluster_id").alias("cluster_id"), F.min("m").cast("bigint").alias("t_start_s"), F.max("m").cast("bigint").alias("t_end_s"),
        F.count("*").alias("n_points"), F.sort_array(F.collect_list(vertex)).alias("_v"),
    )
    return parts.select("mmsi", "part_id", F.when(F.col("cluster_id").isNull(), "move").otherwise("stop").alias("kind"), "cluster_id", "t_start_s", "t_end_s", "n_points", F.transform("_v", lambda v: v["v"]).alias("coords"))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull, counter-clockwise from the leftmost lowest; points on its sides are no corners."""
    own = sorted(set(points))
    if len(own) < 3:
        return own

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(own) + chain(own[::-1])


def triangulate(corners: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Delaunay triangles of a convex polygon, as numbers of corners: each side's third corner is the one whose circle with it holds no other."""

    def angle(a, b, c) -> float:
        ux, uy, vx, vy = a[0] - c[0], a[1] - c[1], b[0] - c[0], b[1] - c[1]
        return float(np.arctan2(abs(ux * vy - uy * vx), ux * vx + uy * vy))

    out, todo = [], [list(range(len(corners)))]
    while todo:
        ring = todo.pop()
        if len(ring) < 3:
            continue
        a, b = ring[0], ring[-1]
        k = max(range(1, len(ring) - 1), key=lambda i: (angle(corners[a], corners[b], corners[ring[i]]), -i))
        out.append(tuple(sorted((a, ring[k], b))))
        todo += [ring[: k + 1], ring[k:]]
    return sorted(out)


POLYGON = "array<struct<x: double, y: double>>"


def stop_hulls(parts: DataFrame) -> DataFrame:
    """mmsi, part_id, cluster_id, t_start_s, t_end_s, hull of every stop."""

    def run(batches):
        for b in batches:
            hulls = [[{"x": x, "y": y} for x, y in convex_hull([(c["x"], c["y"]) for c in v])] for v in b["coords"]]
            yield b.drop(columns="coords").assign(hull=hulls)

    stops = parts.filter(F.col("kind") == "stop").select("mmsi", "part_id", "cluster_id", "t_start_s", "t_end_s", "coords")
    return stops.mapInPandas(run, f"mmsi {dict(parts.dtypes)['mmsi']}, part_id bigint, cluster_id bigint, t_start_s bigint, t_end_s bigint, hull {POLYGON}")


def stop_triangles(hulls: DataFrame) -> DataFrame:
    """mmsi, part_id, x1, y1 .. x3, y3 of the triangles of every hull with an area."""

    def run(batches):
        for b in batches:
            rows = []
            for mmsi, part, hull in zip(b["mmsi"], b["part_id"], b["hull"]):
                ring = [(p["x"], p["y"]) for p in hull]
                rows += [(mmsi, part, *ring[i], *ring[j], *ring[k]) for i, j, k in triangulate(ring)]
            yield pd.DataFrame(rows, columns=["mmsi", "part_id", "x1", "y1", "x2", "y2", "x3", "y3"])

    return hulls.select("mmsi", "part_id", "hull").mapInPandas(run, f"mmsi {dict(hulls.dtypes)['mmsi']}, part_id bigint, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
