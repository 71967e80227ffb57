"""Sinks that can be written twice: rows whose key is already there are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.lookups import first_by
from wakeline.sources.wkb import to_wkb

INTERVAL_KEY = ("mmsi", "t_start")
SPLIT_KEY = ("mmsi", "dist_thres", "time_thres_s", "sub_traj")


def fresh(rows: DataFrame, there: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Rows to insert: one of each key (the least), and none whose key is there."""
    rest = [c for c in rows.columns if c not in key]
    once = first_by(rows, list(key), rest) if rest else rows.select(*key).distinct()
    once = once.select(rows.columns)
    if there is None:
        return once
    known = there.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = [once[k].eqNullSafe(known[f"_{k}"]) for k in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return once.join(known, on, "left_anti")


def sub_traj_intervals(intervals: DataFrame) -> DataFrame:
    """Rows of the interval sink from (mmsi, t_start_s, duration_s)."""
    return intervals.select("mmsi", F.timestamp_seconds("t_start_s").alias("t_start"), F.col("duration_s").cast("double").alias("duration_s"))


def trajectory_splits(pieces: DataFrame, metres: float, seconds: float) -> DataFrame:
    """Rows of the geometry sink from pieces with coords."""
    return pieces.select("mmsi", F.lit(float(metres)).alias("dist_thres"), F.lit(float(seconds)).alias("time_thres_s"), to_wkb("coords").alias("sub_traj"))


def append(rows: DataFrame, path: str, key: Sequence[str]) -> None:
    """Add the fresh rows to a Parquet table, in one commit.  Written again, nothing changes."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    there = spark.read.schema(rows.schema).parquet(path) if exists else None
    fresh(rows, there, key).write.mode("append").parquet(path)


def append_jdbc(rows: DataFrame, options: dict[str, str], key: Sequence[str]) -> None:
    """The same for a database table; all of a partition's rows are one transaction."""
    there = rows.sparkSession.read.format("jdbc").options(**options).load()
    fresh(rows, there, key).write.format("jdbc").options(**options).mode("append").save()


def export_csv(rows: DataFrame, path: str) -> None:
    """One file with a header: for reports, not for tables that grow."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
