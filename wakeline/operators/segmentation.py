"""Cutting trajectories wherever two vertices in a row are not close enough.

Vertices are rows (key, m, pos, x, y): m is the time in seconds, pos breaks ties.  One shuffle by key serves the
lags, the running sum and the aggregation; all of it is built-in but the geodesic distance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.geo import euclidean, haversine
from wakeline.functions.geodesic import geodesic

KEY, ORDER = ("mmsi",), ("m", "pos")
METRICS = {"haversine": haversine, "euclidean": euclidean, "geodesic": geodesic}


@dataclass(frozen=True)
class SplitRule:
    """Two vertices stay together if they are less than `metres` and `seconds` apart (either may be None: not asked).
    op "<" or "<=", combine "and" or "or".  The defaults are those of the production job."""

    metres: float | None = 1000.0
    seconds: float | None = 60.0
    metric: str = "geodesic"
    op: str = "<"
    combine: str = "and"

    def __post_init__(self) -> None:
        if self.metric not in METRICS or self.op not in ("<", "<=") or self.combine not in ("and", "or"):
            raise ValueError(f"no such rule: {self}")
        if self.metres is None and self.seconds is None:
            raise ValueError("a rule needs a distance or a time")

    def keeps(self, metres: Column | None, seconds: Column) -> Column:
        compare = (lambda a, b: a < b) if self.op == "<" else (lambda a, b: a <= b)
        parts = [compare(a, F.lit(float(b))) for a, b in ((metres, self.metres), (seconds, self.seconds)) if b is not None]
        return reduce(lambda a, b: a & b if self.combine == "and" else a | b, parts)


def _window(key, order):
    return Window.partitionBy(*key).orderBy(*order)


def steps(points: DataFrame, metric: str | None = None, key=KEY, order=ORDER) -> DataFrame:
    """Add step_s (seconds since the vertex before) and, with a metric, step_m (metres); NULL on the first vertex."""
    w = _window(key, order)
    out = points.withColumns({"step_s": F.col("m") - F.lag("m").over(w)} | ({"_px": F.lag("x").over(w), "_py": F.lag("y").over(w)} if metric else {}))
    return out.withColumn("step_m", METRICS[metric]("_px", "_py", "x", "y")).drop("_px", "_py") if metric else out


def segment(points: DataFrame, rule: SplitRule = SplitRule(), key=KEY, order=ORDER) -> DataFrame:
    """Add seg_id, from 0 in each trajectory.  All vertices stay, in their order."""
    out = steps(points, rule.metric if rule.metres is not None else None, key, order)
    keeps = rule.keeps(F.col("step_m") if rule.metres is not None else None, F.col("step_s"))
    new = F.when(F.col("step_s").isNull() | ~F.coalesce(keeps, F.lit(False)), 1).otherwise(0)
    seg = F.sum(new).over(_window(key, order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    return out.withColumn("seg_id", seg).drop("step_s", "step_m")


def segment_in_parts(points: DataFrame, rule: SplitRule, width: float, key=KEY, order=ORDER) -> DataFrame:
    """What `segment` gives, for trajectories too long for one task: time is cut into parts of `width` seconds and rows are dealt by (key, part).
    Only a row for each part (its first and last vertex, its number of cuts) is brought together by key."""
    rows = points.withColumn("_part", F.floor(F.col("m") / F.lit(width)))
    vertex = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "m", "x", "y")
    ends = rows.groupBy(*key, "_part").agg(F.max(vertex).alias("_last"))
    before = F.lag("_last").over(_window(key, ["_part"]))
    ends = ends.select(*key, "_part", before["m"].alias("_bm"), before["x"].alias("_bx"), before["y"].alias("_by"))
    w = _window((*key, "_part"), order)
    prior = lambda c, b: F.coalesce(F.lag(c).over(w), F.col(b))
    out = rows.join(ends, [*key, "_part"]).withColumns({"_pm": prior("m", "_bm"), "_px": prior("x", "_bx"), "_py": prior("y", "_by")})
    metres = METRICS[rule.metric]("_px", "_py", "x", "y") if rule.metres is not None else None
    keeps = F.coalesce(rule.keeps(metres, F.col("m") - F.col("_pm")), F.lit(False))
    out = out.withColumn("_new", F.when(F.col("_pm").isNull() | ~keeps, 1).otherwise(0))
    out = out.withColumn("_own", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = out.groupBy(*key, "_part").agg(F.sum("_new").alias("_n"))
    so_far = F.coalesce(F.sum("_n").over(_window(key, ["_part"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*key, "_part", so_far.alias("_before"))
    return out.join(sums, [*key, "_part"]).select(*points.columns, (F.col("_own") + F.col("_before") - 1).alias("seg_id"))


def summaries(segments: DataFrame, key=KEY) -> DataFrame:
    """n_points, m_first, m_last of every segment."""
    return segments.groupBy(*key, "seg_id").agg(F.count("*").alias("n_points"), F.min("m").alias("m_first"), F.max("m").alias("m_last"))


def intervals(segments: DataFrame, key=KEY) -> DataFrame:
    """t_start_s and duration_s of every segment: whole seconds, the end rounded up; a single vertex lasts 0."""
    start = F.col("m_first").cast("bigint")
    long = F.ceil(F.col("m_last")).cast("bigint") - start
    return summaries(segments, key).select(*key, "seg_id", start.alias("t_start_s"), F.when(F.col("n_points") == 1, F.lit(0).cast("bigint")).otherwise(long).alias("duration_s"))


def pieces(segments: DataFrame, key=KEY, order=ORDER) -> DataFrame:
    """A row for each segment: kind ('point' for a single vertex, else 'sub') and its vertices in order."""
    vertex = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("m").cast("double").alias("m")).alias("v"))
    rows = segments.groupBy(*key, "seg_id").agg(F.sort_array(F.collect_list(vertex)).alias("_v"))
    return rows.select(*key, "seg_id", F.when(F.size("_v") == 1, "point").otherwise("sub").alias("kind"), F.transform("_v", lambda v: v["v"]).alias("coords"))


def concatenated(parts: DataFrame, key=KEY) -> DataFrame:
    """The trajectories again, from their pieces in the order of seg_id; `valid` as for any linestring."""
    from wakeline.functions.geo import valid_linestring

    rows = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("seg_id", "coords"))).alias("_p"))
    return rows.select(*key, F.flatten(F.transform("_p", lambda p: p["coords"])).alias("coords")).withColumn("valid", valid_linestring("coords"))


def thresholds(least: int = 2, most: float = 2500) -> list[float]:
    """Powers of two from 2 ** least on, up to `most`."""
    out, k = [], least
    while 2.0**k <= most:
        out.append(2.0**k)
        k += 1
    return out


def threshold_sweep(points: DataFrame, limits: list[float], metric: str = "haversine", key=KEY, order=ORDER) -> DataFrame:
    """For each trajectory and distance limit: total_len vertices, num_splits pieces (a step of the limit or more cuts), and their whole quotient.
    Steps are made once; all limits are counted in one aggregation."""
    s = steps(points, metric, key, order)
    counts = [F.sum(F.when(F.col("step_m") >= limit, 1).otherwise(0)).alias(f"c{i}") for i, limit in enumerate(limits)]
    rows = s.groupBy(*key).agg(F.count("*").alias("total_len"), *counts)
    each = F.explode(F.array(*[F.struct(F.lit(float(limit)).alias("threshold"), (F.col(f"c{i}") + 1).alias("num_splits")) for i, limit in enumerate(limits)]))
    return rows.select(*key, "total_len", each.alias("t")).select(*key, "t.threshold", "total_len", "t.num_splits", F.expr("total_len div t.num_splits").alias("avg_subtraj_len"))


def lines(points: DataFrame, key=KEY, order=ORDER) -> DataFrame:
    """Each vertex with the one after it (x2, y2, m2): a line less than there are vertices."""
    w = _window(key, order)
    return points.withColumns({f"{c}2": F.lead(c).over(w) for c in ("x", "y", "m")}).filter(F.col("m2").isNotNull())


def violations(points: DataFrame, key=KEY, order=("pos",)) -> DataFrame:
    """n_points and n_violations of each trajectory: vertices earlier than the one before, and one if there is a single vertex."""
    w = _window(key, order)
    rows = points.withColumn("_falls", F.when(F.col("m") < F.lag("m").over(w), 1).otherwise(0)).groupBy(*key).agg(F.count("*").alias("n_points"), F.sum("_falls").alias("_f"))
    return rows.select(*key, "n_points", (F.col("_f") + F.when(F.col("n_points") == 1, 1).otherwise(0)).alias("n_violations"))


def clip(points: DataFrame, begin: float, end: float) -> DataFrame:
    """Vertices between two times, ends included, in whole seconds; trajectories left empty vanish."""
    return points.filter(F.col("m").between(int(begin), int(end)))
