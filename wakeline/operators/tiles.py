"""Unions of intervals, tiles of single ships, and their reduction to tiles of all ships.  All native."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators.lookups import by_ship
from wakeline.operators.ranges import gather
from wakeline.session import shared_path

CELL = ("x", "y", "z")
#: Type of sums of nanoseconds over ships: 3600 ships that lie in one cell for a month pass BIGINT, which holds 292 years.
WIDE = "decimal(38,0)"


def union_intervals(rows: DataFrame, key, begin: str = "t_begin_ns", end: str = "t_end_ns") -> DataFrame:
    """Unions of the intervals of each key; those that touch are one."""
    w = Window.partitionBy(*key).orderBy(begin, end)
    so_far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(so_far.isNull() | (F.col(begin) > so_far), 1).otherwise(0)
    marked = rows.select(*key, begin, end).withColumn("_new", new)
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "_island").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("_island")


def ship_tiles(cells: DataFrame, sog: DataFrame, draught: DataFrame, dimensions: DataFrame, bin_ns: int, merged: bool = False) -> DataFrame:
    """Tiles of each ship from its cells (mmsi, x, y, z, t_begin_ns, t_end_ns).

    sog: mmsi, t_ns, sog and `seq`, which decides between samples of the same time; draught: mmsi, d_begin_ns, d_end_ns, draught; dimensions: mmsi, width, length.
    Samples and spans that touch one of the cell's intervals count; NaN values do not."""
    spans = cells if merged else union_intervals(cells, ("mmsi", *CELL))
    key = ("mmsi", *CELL)
    real = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    last = sog.groupBy("mmsi", "t_ns").agg(F.max(F.struct("seq", "sog")).getField("sog").alias("sog"))
    speeds = last.select("mmsi", F.col("t_ns").alias("f_begin"), F.col("t_ns").alias("f_end"), real("sog").alias("sog"), F.lit(None).cast("double").alias("draught"))
    depths = draught.select("mmsi", F.col("d_begin_ns").alias("f_begin"), F.col("d_end_ns").alias("f_end"), F.lit(None).cast("double").alias("sog"), real("draught").alias("draught"))
    aggs = {"min_sog": F.min("sog"), "max_sog": F.max("sog"), "max_draught": F.max("draught")}
    each = gather(spans, speeds.unionByName(depths), ("t_begin_ns", "t_end_ns"), ("f_begin", "f_end"), bin_ns, key, aggs)
    time = F.sum(F.col("t_end_ns") - F.col("t_begin_ns")).alias("cell_oc_ns")
    out = each.groupBy(*key).agg(time, F.min("min_sog").alias("min_sog"), F.max("max_sog").alias("max_sog"), F.max("max_draught").alias("max_draught"))
    out = by_ship(out, dimensions.select("mmsi", "width", "length"), ("length", "width"))
    return out.select(
        "mmsi", *CELL, "max_draught", F.lit(1).cast("bigint").alias("distinct_ship_count"), "min_sog", "max_sog", "cell_oc_ns",
        F.col("length").alias("min_length"), F.col("length").alias("max_length"), F.col("width").alias("min_width"), F.col("width").alias("max_width"),
    )


def _merged() -> list:
    real = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    return [
        F.max(real("max_draught")).alias("max_draught"), F.min(real("min_sog")).alias("min_sog"), F.max(real("max_sog")).alias("max_sog"), F.sum(F.col("cell_oc_ns").cast(WIDE)).alias("cell_oc_ns"),
        F.min(real("min_length")).alias("min_length"), F.max(real("max_length")).alias("max_length"), F.min(real("min_width")).alias("min_width"), F.max(real("max_width")).alias("max_width"),
    ]


ORDER = (*CELL, "max_draught", "distinct_ship_count", "min_sog", "max_sog", "cell_oc_ns", "min_length", "max_length", "min_width", "max_width")


def combine(tiles: DataFrame) -> DataFrame:
    """One tile for each cell: extremes, with NULL for none, and sums.  Ship counts are summed, so a ship counts as often as it has tiles there.  Times are DECIMAL(38,0)."""
    return tiles.groupBy(*CELL).agg(F.sum("distinct_ship_count").alias("distinct_ship_count"), *_merged()).select(*ORDER)


def rezoom(tiles: DataFrame, zoom: int) -> DataFrame:
    """The tiles' cells at another zoom; tiles that then share a cell are still separate."""
    z = F.lit(zoom)
    return tiles.withColumns({"x": geo.rezoom("x", "z", z), "y": geo.rezoom("y", "z", z), "z": z})


def pyramid(of_ships: DataFrame, zooms: list[int]) -> DataFrame:
    """Tiles of all ships at each of the zooms, each ship counted once a cell, from the tiles of ships at a deeper one.  Ships' tiles are merged before they are counted, a
    zoom in one pass: every row is dealt to all zooms at once.  Times as in `combine`."""
    at = of_ships.withColumn("_z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    at = at.withColumns({"x": geo.rezoom("x", "z", "_z"), "y": geo.rezoom("y", "z", "_z"), "z": F.col("_z")}).drop("_z")
    once = at.groupBy("mmsi", *CELL).agg(*_merged()).withColumn("distinct_ship_count", F.lit(1).cast("bigint"))
    return combine(once)


def narrow(tiles: DataFrame) -> DataFrame:
    """The tiles with times as BIGINT if all of them fit, else as they are.  Only the sums can tell, so the tiles are made now, once, and written to the shared folder."""
    path = shared_path(tiles.sparkSession, "tiles")
    tiles.write.parquet(path)
    whole = tiles.sparkSession.read.schema(tiles.schema).parquet(path)
    fits = F.col("cell_oc_ns").try_cast("bigint")
    if whole.filter(F.col("cell_oc_ns").isNotNull() & fits.isNull()).limit(1).count():
        return whole
    return whole.withColumn("cell_oc_ns", fits)
