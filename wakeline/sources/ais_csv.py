"""Raw AIS files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline import schemas

#: Format of the files' timestamps (fixed value).
TIME = "dd/MM/yyyy HH:mm:ss"


def parse_time(c: Column | str, strict: bool = True) -> Column:
    """Timestamp of such a text; one that isn't is an error, or NULL if not strict."""
    return F.to_timestamp(c, TIME) if strict else F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(TIME))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All 26 columns, typed, with the times as timestamps.  A row that doesn't fit fails the read, or gives NULLs if not strict."""
    reader = spark.read.schema(schemas.ais_csv()).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    rows = reader.csv(path)
    return rows.withColumns({"# Timestamp": parse_time(F.col("`# Timestamp`"), strict), "ETA": parse_time("ETA", strict)})


def positions(rows: DataFrame) -> DataFrame:
    """Vertices (mmsi, m, x, y, sog) of the ships in the file that have a valid id and a position."""
    from wakeline.operators.lookups import valid_mmsi

    rows = rows.filter(valid_mmsi("MMSI") & F.col("Latitude").between(-90, 90) & F.col("Longitude").between(-180, 180))
    return rows.select(F.col("MMSI").cast("int").alias("mmsi"), F.unix_micros("`# Timestamp`").alias("m_us"), F.col("Longitude").alias("x"), F.col("Latitude").alias("y"), F.col("SOG").alias("sog")).withColumn("m", F.col("m_us") / 1e6)
