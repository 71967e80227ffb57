"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in columns.items()))


DEGREES, METRES = 4326, 3857  # reference systems: longitude and latitude; Web-Mercator metres

COORD = T.StructType([T.StructField(c, T.DoubleType()) for c in "xym"])
COORDS = T.ArrayType(COORD)

#: Tables a ship database holds, by name.  `trajectories` is long form: a row for each vertex.
TABLES = {
    "trajectories": dict(mmsi="int", pos="bigint", x="double", y="double", m="double"),
    "nav_status": dict(mmsi="int", time_begin="timestamp", time_end="timestamp", status_name="string"),
    "draught": dict(mmsi="int", time_begin="timestamp", time_end="timestamp", draught="float"),
    "cog": dict(mmsi="int", timestamp="timestamp", cog="float"),
    "sog": dict(mmsi="int", timestamp="timestamp", sog="float"),
    "rot": dict(mmsi="int", timestamp="timestamp", rot="float"),
    "dimensions": dict(mmsi="int", width="double", length="double"),
    "gps_position": dict(mmsi="int", a="double", b="double", c="double", d="double"),
    "stop_object": dict(mmsi="int", time_begin="timestamp", time_end="timestamp", geom="binary"),
}

SUB_TRAJ_INTERVAL = dict(mmsi="int", t_start="timestamp", duration_s="double")
TRAJECTORY_SPLITS = dict(mmsi="int", dist_thres="double", time_thres_s="double", sub_traj="binary")

#: Columns of a raw AIS file, as its header names them (fixed values).
AIS_CSV = {
    "# Timestamp": "string", "Type of mobile": "string", "MMSI": "bigint", "Latitude": "double", "Longitude": "double",
    "Navigational status": "string", "ROT": "double", "SOG": "double", "COG": "double", "Heading": "int", "IMO": "string",
    "Callsign": "string", "Name": "string", "Ship type": "string", "Cargo type": "string", "Width": "int", "Length": "int",
    "Type of position fixing device": "string", "Draught": "double", "Destination": "string", "ETA": "string",
    "Data source type": "string", "A": "int", "B": "int", "C": "int", "D": "int",
}

#: One tile: the engine's principal output.  cell_oc_ns is the time in the cell, in nanoseconds.
TILE = dict(x="bigint", y="bigint", z="int", max_draught="double", distinct_ship_count="bigint", min_sog="double", max_sog="double", cell_oc_ns="bigint", min_length="double", max_length="double", min_width="double", max_width="double")


def schema(name: str) -> T.StructType:
    return _table(**TABLES[name])


def ais_csv() -> T.StructType:
    return _table(**AIS_CSV)
