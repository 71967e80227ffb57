"""Tables of a ship database: from JDBC, Parquet or any DataFrames, and windows of them.

Filters are plain comparisons on stored columns, so they reach the Parquet or JDBC scan.  Times given are seconds, and cut to whole ones.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline import schemas
from wakeline.operators.lookups import members
from wakeline.operators.segmentation import clip


@dataclass(frozen=True)
class Database:
    """Connection settings; `from_env` reads DB_HOSTNAME, DB_PORT, DB_USERNAME, DB_PASSWORD and DB_NAME."""

    hostname: str
    port: int
    username: str
    password: str
    name: str
    schema: str = "program_data"
    driver: str = "org.postgresql.Driver"
    url: str = ""  # in place of host, port and name, for other databases

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Database:
        env = os.environ if env is None else env
        missing = [k for k in ("DB_HOSTNAME", "DB_PORT", "DB_USERNAME", "DB_PASSWORD", "DB_NAME") if k not in env]
        if missing:
            raise KeyError(f"not set: {', '.join(missing)}")
        return cls(env["DB_HOSTNAME"], int(env["DB_PORT"]), env["DB_USERNAME"], env["DB_PASSWORD"], env["DB_NAME"])

    def options(self, table: str) -> dict[str, str]:
        return {"url": self.url or f"jdbc:postgresql://{self.hostname}:{self.port}/{self.name}", "user": self.username, "password": self.password, "dbtable": f"{self.schema}.{table}", "driver": self.driver}

    def read(self, spark: SparkSession, table: str, partitions: int = 1, ships: tuple[int, int] | None = None) -> DataFrame:
        """A table; with a range of ship ids, read by that many connections at once."""
        options = self.options(table)
        if partitions > 1 and ships:
            options |= {"partitionColumn": "mmsi", "lowerBound": str(ships[0]), "upperBound": str(ships[1]), "numPartitions": str(partitions)}
        return spark.read.format("jdbc").options(**options).load()


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.schema(name)).parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Ships:
    """The tables, by name."""

    tables: Mapping[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def window(self, begin: float, end: float) -> Ships:
        """All tables between two times; attributes only of ships that have a trajectory then."""
        tracks = clip(self.trajectories, begin, end)
        ships = tracks.select("mmsi").distinct()
        out = {"trajectories": tracks}
        out |= {n: at_times(self.tables[n], begin, end) for n in ("cog", "sog", "rot") if n in self.tables}
        out |= {n: meeting(self.tables[n], begin, end) for n in ("nav_status", "draught", "stop_object") if n in self.tables}
        out |= {n: members(self.tables[n], ships) for n in ("dimensions", "gps_position") if n in self.tables}
        return Ships(out)


def _stamp(second: float):
    return F.timestamp_seconds(F.lit(int(second)))


def at_times(samples: DataFrame, begin: float, end: float, t: str = "timestamp") -> DataFrame:
    """Samples between two times, ends included."""
    return samples.filter(F.col(t).between(_stamp(begin), _stamp(end)))


def meeting(spans: DataFrame, begin: float, end: float, first: str = "time_begin", last: str = "time_end") -> DataFrame:
    """Intervals that share a moment with the window."""
    return spans.filter((F.col(last) >= _stamp(begin)) & (F.col(first) <= _stamp(end)))


def page(table: DataFrame, number: int, size: int = 500, order=("mmsi",)) -> DataFrame:
    """A page of the ordered table.  For whole tables read partitions instead; with ties in `order` pages are not stable."""
    return table.orderBy(*order).offset(number * size).limit(size)


def ship_pages(table: DataFrame, size: int = 500, key: str = "mmsi") -> DataFrame:
    """Page number of every ship, from 0, in order of the key: what paging by ships would give, without reading page by page.
    Ranks are made inside ranges of the key and added up, so no task has to hold all ships."""
    ships = table.select(key).distinct().withColumn("_block", F.floor(F.col(key) / 4096))
    from pyspark.sql import Window

    counts = ships.groupBy("_block").agg(F.count("*").alias("_n"))
    before = counts.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1
    return ships.withColumn("_own", own).join(before, "_block").select(key, F.floor((F.col("_own") + F.col("_before")) / size).cast("bigint").alias("page"))
