"""Lookups of ship attributes: each takes the rows that ask, and returns them with what they found."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.ranges import overlap, stab

#: Rows of a dimension table up to which it is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 2_000_000

#: Status strings and the names of their values (fixed values).
NAV_STATUS = {
    "aground": "Aground",
    "ais-sart (active)": "AisSart",
    "at anchor": "AtAnchor",
    "constrained by her draught": "ConstrainedByDraught",
    "engaged in fishing": "EngagedInFishing",
    "moored": "Moored",
    "not under command": "NotUnderCommand",
    "restricted maneuverability": "RestrictedManeuverability",
    "under way sailing": "UnderWaySailing",
    "under way using engine": "UnderWayUsingEngine",
}


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if a count finds it within the limit, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key: the first in that order, by partial aggregation."""
    rest = [c for c in df.columns if c not in key]
    best = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v_{c}") for c in rest])).alias("_b")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_b.v_{c}").alias(c) for c in rest])


def at_time(asks: DataFrame, samples: DataFrame, t: str = "m", key: str = "mmsi", order: Sequence[str] = ()) -> DataFrame:
    """Value sampled at exactly that time; of several samples the first in `order`; rows without one are left out."""
    value = [c for c in samples.columns if c not in (key, t)]
    return asks.join(first_by(samples, [key, t], order or value), [key, t])


def holding(asks: DataFrame, spans: DataFrame, t: str, begin: str, end: str, width: int, ask_id: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The interval that holds the time, ends included; of several the first by `order` (default: by begin, then end)."""
    return first_by(stab(asks, spans, t, begin, end, width), list(ask_id), [*(order or (begin, end)), *[c for c in spans.columns if c not in (begin, end, "mmsi")]])


def overlapping(asks: DataFrame, spans: DataFrame, ask_span: tuple[str, str], span: tuple[str, str], width: int) -> DataFrame:
    """All intervals that share a moment with the one asked for."""
    return overlap(asks, spans, ask_span, span, width)


def between(asks: DataFrame, samples: DataFrame, t: str, begin: str, end: str, width: int, order: str) -> DataFrame:
    """All samples within the interval asked for.  Of samples with equal ship and time the last by `order` counts."""
    rest = [c for c in samples.columns if c not in ("mmsi", t)]
    last = samples.groupBy("mmsi", t).agg(F.max(F.struct(F.col(order).alias("o"), *[F.col(c).alias(f"v_{c}") for c in rest])).alias("_l"))
    last = last.select("mmsi", t, *[F.col(f"_l.v_{c}").alias(c) for c in rest])
    return stab(last, asks, t, begin, end, width)


def by_ship(asks: DataFrame, table: DataFrame, order: Sequence[str], how: str = "left") -> DataFrame:
    """Attributes of the ship (its first row in that order); NULL where it has none, with how="left"."""
    return asks.join(small(first_by(table, ["mmsi"], order)), "mmsi", how)


def members(table: DataFrame, ships: DataFrame) -> DataFrame:
    """Rows of ships that are in the list."""
    return table.join(small(ships.select("mmsi").distinct()), "mmsi", "left_semi")


def valid_mmsi(mmsi: Column | str = "mmsi") -> Column:
    return F.length(F.col(mmsi).cast("string") if isinstance(mmsi, str) else mmsi.cast("string")) == 9


def nav_status(status: Column | str, strict: bool = True) -> Column:
    """Value of a status string, in any case; an unknown one is an error, or NULL if not strict."""
    text = F.lower(F.col(status) if isinstance(status, str) else status)
    known = F.try_element_at(F.create_map(*[F.lit(v) for v in chain(*NAV_STATUS.items())]), text)
    if not strict:
        return known
    return F.when(text.isNull() | known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown navigational status: "), text)).cast("string"))


def cluster_of(label: str = "label", cluster: str = "cluster_id") -> Column:
    """Cluster of a core or edge point; NULL for others."""
    return F.when(F.col(label).isin("core", "edge"), F.col(cluster))
