"""Vessel tables made from the test tables `events` and `customer`: every user is a ship on a walk whose steps are its events' numbers.

Sums are of whole numbers, so positions are the same wherever they are computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Event types and the status each stands for.
STATUS = {"click": "moored", "view": "under way using engine", "purchase": "at anchor", "signup": "aground", "error": "engaged in fishing"}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, mmsi, pos, m_us, m, k, event_type, sog, x, y."""
    w = Window.partitionBy("mmsi").orderBy("m_us", "event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", (F.col("user_id") + 200_000_000).cast("int").alias("mmsi"), F.unix_micros(F.col("ts").cast("timestamp")).alias("m_us"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type", (F.col("value") / 50.0).alias("sog"),
    )
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    walk = lambda c: F.sum(c).over(so_far) / F.lit(1000.0)
    return rows.select(
        "event_id", "mmsi", F.row_number().over(w).cast("bigint").alias("pos"), "m_us", F.expr("m_us div 1000000").alias("m"), "k", "event_type", "sog",
        (F.lit(10.0) + walk(F.col("k") % 11 - 5)).alias("x"), (F.lit(56.0) + walk(F.expr("k div 11") - 4)).alias("y"),
    )


def spans(points: DataFrame) -> DataFrame:
    """mmsi, time_begin, time_end (seconds; the next vertex's time), event_type, draught: one for each vertex."""
    w = Window.partitionBy("mmsi").orderBy("m_us", "event_id")
    return points.select("mmsi", F.col("m").alias("time_begin"), F.coalesce(F.lead("m").over(w), F.col("m")).alias("time_end"), "event_type", (F.lit(1.0) + (F.col("k") % 20) / F.lit(2.0)).alias("draught"))


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mmsi, width, length, a, b, c, d: whole numbers of metres, from the customer with the user's number."""
    key = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        (key + 200_000_000).cast("int").alias("mmsi"), (key % 30 + 5).cast("double").alias("width"), (key % 200 + 20).cast("double").alias("length"),
        (key % 100 + 10).cast("double").alias("a"), (key % 50 + 10).cast("double").alias("b"), (key % 15 + 2).cast("double").alias("c"), (key % 15 + 3).cast("double").alias("d"),
    )
