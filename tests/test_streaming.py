import time

from pyspark.sql import functions as F

from wakeline.operators import segmentation as seg
from wakeline.operators.segmentation import SplitRule
from wakeline.sources import events_view
from wakeline.streaming.sessions import segments, time_sessions

DIR = "/root/testdata/sf0.001"


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def wait(done, seconds=60):
    end = time.monotonic() + seconds
    while not done():
        assert time.monotonic() < end
        time.sleep(0.2)


def test_segments_of_a_stream(spark, tmp_path):
    points = events_view.points(spark, DIR)
    points.select("mmsi", F.col("m").cast("double").alias("m"), "x", "y").repartition(1).write.parquet(str(tmp_path / "in"))
    rule = SplitRule(300.0, 21_600, "haversine")
    stream = spark.readStream.schema("mmsi int, m double, x double, y double").parquet(str(tmp_path / "in"))
    got = run(segments(stream, rule), tmp_path, "seg")
    batch = seg.summaries(seg.segment(points, rule))
    last = batch.groupBy("mmsi").agg(F.max("seg_id").alias("seg_id"))
    want = batch.join(last, ["mmsi", "seg_id"], "left_anti")  # the last one of each ship is still open
    rows = lambda df: sorted((r.mmsi, r.seg_id, r.n_points, float(r.m_first), float(r.m_last)) for r in df.collect())
    assert rows(got) == rows(want)


def test_sessions_of_a_stream(spark, tmp_path):
    rows = events_view.points(spark, DIR).select("mmsi", F.timestamp_micros("m_us").alias("timestamp"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = run(time_sessions(stream, 21_600), tmp_path, "sessions")
    want = {(r.mmsi, r.t_first): r.n_points for r in time_sessions(rows, 21_600).collect()}
    found = {(r.mmsi, r.t_first): r.n_points for r in got.collect()}
    assert found and found.items() <= want.items()


def test_silence_does_not_reuse_numbers(spark, tmp_path):
    """A ship that was silent long enough goes on with the next number; late vertices are counted."""
    schema, where = "mmsi int, m double, x double, y double", str(tmp_path / "in")
    put = lambda *m: spark.createDataFrame([(1, float(t), 0.0, 0.0) for t in m], schema).coalesce(1).write.mode("append").parquet(where)
    put(0, 1, 2)
    stream = segments(spark.readStream.schema(schema).parquet(where), SplitRule(None, 10), idle=1000)
    q = stream.writeStream.outputMode("append").format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        got = lambda: sorted((r.seg_id, r.n_points, r.m_first, r.m_last, r.n_late) for r in spark.table("idle").collect())
        wait(lambda: len(got()) == 1)
        put(1, 3, 4)
        put(50)
        wait(lambda: len(got()) >= 3)
    finally:
        q.stop()
    assert q.exception() is None
    assert [r[0] for r in got()] == [0, 1, 2] and got()[0] == (0, 3, 0.0, 2.0, 0)
    assert sum(r[4] for r in got()) == 1 and sum(r[1] for r in got()) == 6
