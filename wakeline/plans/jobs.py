"""Whole jobs: what a user runs over a table of trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators import lookups, raster, segmentation as seg, stops, tiles
from wakeline.operators.segmentation import SplitRule
from wakeline.sources import sinks


def segment_job(points: DataFrame, path: str, rule: SplitRule = SplitRule()) -> None:
    """Cut all trajectories and add (mmsi, start, duration) of every piece to the table at `path`.  One commit; run again, it adds nothing."""
    found = seg.intervals(seg.segment(points, rule))
    sinks.append(sinks.sub_traj_intervals(found), path, sinks.INTERVAL_KEY)


def split_job(points: DataFrame, path: str, rule: SplitRule = SplitRule()) -> None:
    """The same with the pieces' geometries and the rule's thresholds."""
    parts = seg.pieces(seg.segment(points, rule))
    sinks.append(sinks.trajectory_splits(parts, rule.metres or 0, rule.seconds or 0), path, sinks.SPLIT_KEY)


def sweep_job(points: DataFrame, path: str, begin: float, end: float, metric: str = "geodesic") -> None:
    """Report of how distance limits of 4 to 2048 m cut the trajectories of valid ships in a window of time, as a CSV file."""
    tracks = seg.clip(points, begin, end).filter(lookups.valid_mmsi())
    bad = seg.violations(tracks).filter("n_violations > 0 AND n_points > 1")
    if bad.limit(1).count():
        raise ValueError("a trajectory is not in order of time")
    sinks.export_csv(seg.threshold_sweep(tracks, seg.thresholds(), metric).orderBy("mmsi", "threshold"), path)


def tile_job(points: DataFrame, sog: DataFrame, draught: DataFrame, dimensions: DataFrame, zooms: list[int], sampling: int = 22, bin_ns: int = 86_400_000_000_000) -> DataFrame:
    """Tiles of all ships at each zoom, from tracks rastered once at the deepest of them.  Tables as for `ship_tiles`; times as in `narrow`."""
    cells = raster.linestring_cells(points, max(zooms), sampling)
    return tiles.narrow(tiles.pyramid(tiles.ship_tiles(cells, sog, draught, dimensions, bin_ns), sorted(zooms, reverse=True)))


def stop_job(points: DataFrame, config: stops.StopConfig = stops.StopConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts of all ships' tracks, hulls of the stops, and triangles of the hulls."""
    parts = stops.stop_parts(stops.label_stops(points, config))
    hulls = stops.stop_hulls(parts)
    return parts, hulls, stops.stop_triangles(hulls)


def footprint_job(points: DataFrame, gps: DataFrame, zoom: int) -> DataFrame:
    """Time that ships' footprints cover cells: (mmsi, x, y, z, t_begin_ns, t_end_ns), merged.  gps: mmsi and the antenna's a, b, c, d."""
    ends = lookups.by_ship(seg.lines(points), gps.select("mmsi", *[F.col(c).cast("double").alias(c) for c in "abcd"]), ("a", "b", "c", "d"), "inner")
    cells = raster.footprint_cells(ends, zoom, ("mmsi", "pos"))
    return tiles.union_intervals(cells.filter("t_end_ns >= t_begin_ns"), ("mmsi", "x", "y", "z"))
