import pytest
from pyspark.sql import functions as F

from wakeline.functions.geo import NS
from wakeline.operators.segmentation import SplitRule
from wakeline.operators.stops import StopConfig
from wakeline.plans import jobs, queries
from wakeline.sources import events_view as view

DIR = "/root/testdata/sf0.001"
RULE = SplitRule(None, queries.SECONDS)


def test_segment_job(spark, tmp_path):
    points = view.points(spark, DIR)
    for _ in range(2):
        jobs.segment_job(points, str(tmp_path / "i"), RULE)
        jobs.split_job(points, str(tmp_path / "g"), RULE)
    assert spark.read.parquet(str(tmp_path / "i")).count() == 585 == spark.read.parquet(str(tmp_path / "g")).count()


def test_sweep_job(spark, tmp_path):
    points = view.points(spark, DIR)
    jobs.sweep_job(points, str(tmp_path / "s"), queries.BEGIN, queries.END)
    (file,) = (tmp_path / "s").glob("part-*")
    rows = file.read_text().split()
    assert rows[0] == "mmsi,threshold,total_len,num_splits,avg_subtraj_len" and len(rows) == 1 + 15 * 10
    with pytest.raises(ValueError, match="order"):
        jobs.sweep_job(points.withColumn("m", F.lit(2 * queries.BEGIN) - F.col("m")), str(tmp_path / "t"), 0, 2 * queries.BEGIN)


def test_tile_and_footprint_jobs(spark):
    points, dims = view.points(spark, DIR), view.dimensions(spark, DIR)
    sog = points.select("mmsi", (F.col("m") * NS).alias("t_ns"), F.col("event_id").alias("seq"), "sog")
    draught = view.spans(points).select("mmsi", (F.col("time_begin") * NS).alias("d_begin_ns"), (F.col("time_end") * NS).alias("d_end_ns"), "draught")
    got = jobs.tile_job(points, sog, draught, dims, [queries.ZOOM - 4, queries.ZOOM - 2, queries.ZOOM], queries.SAMPLING)
    want = queries.tile_pyramid(spark, DIR)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert jobs.footprint_job(points, dims, 16).count() == queries.footprint_cells(spark, DIR).count()


def test_stop_job(spark):
    parts, hulls, triangles = jobs.stop_job(view.points(spark, DIR), StopConfig(4, 600.0, 86_400.0, 1.5, "haversine"))
    assert parts.filter("kind = 'stop'").count() == hulls.count() > 0 and triangles.count() == sum(max(0, len(r.hull) - 2) for r in hulls.collect())
