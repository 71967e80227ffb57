"""Segmentation of streams, an extension: the batch rules on vertices as they come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.segmentation import SplitRule
from wakeline.operators.stops import DISTANCES


def time_sessions(points: DataFrame, seconds: int, late: str = "10 minutes", t: str = "timestamp") -> DataFrame:
    """n_points, first and last time of runs of vertices at most `seconds` apart, final once the watermark has passed them.
    Unlike a rule with "<", vertices exactly `seconds` apart stay together: that is how session windows merge."""
    rows = points.withWatermark(t, late).groupBy("mmsi", F.session_window(t, f"{seconds} seconds"))
    return rows.agg(F.count("*").alias("n_points"), F.min(t).alias("t_first"), F.max(t).alias("t_last")).drop("session_window")


OUT = "mmsi int, seg_id bigint, n_points bigint, m_first double, m_last double, n_late bigint, complete boolean"
STATE = "seg_id bigint, n_points bigint, m_first double, m_last double, x double, y double, n_late bigint"
COLUMNS = ["mmsi", "seg_id", "n_points", "m_first", "m_last", "n_late", "complete"]


def segments(points: DataFrame, rule: SplitRule, idle: int = 3_600_000) -> DataFrame:
    """Segments by distance and time of a stream of (mmsi, m, x, y).  A segment is sent, complete, when a vertex cuts it, and when a ship has been
    silent for `idle` milliseconds.  Numbers go on after such a silence, so (mmsi, seg_id) is unique; a few numbers of each ship are kept for that.
    Vertices older than a ship's last one are passed over, and counted in `n_late` of the next segment sent; within a batch they are put in order."""
    metric = DISTANCES[rule.metric] if rule.metres is not None else None

    def keeps(metres: float, seconds: float) -> bool:
        inside = (lambda a, b: a < b) if rule.op == "<" else (lambda a, b: a <= b)
        parts = [inside(a, b) for a, b in ((metres, rule.metres), (seconds, rule.seconds)) if b is not None]
        return all(parts) if rule.combine == "and" else any(parts)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seg, n, first, last, x, y, late = state.get
            state.update((seg + 1, 0, last, last, x, y, 0))
            yield pd.DataFrame([(key[0], seg, n, first, last, late, True)], columns=COLUMNS)
            return
        own = state.get if state.exists else None
        rows, out = pd.concat(list(batches)).sort_values("m", kind="stable"), []
        for m, x, y in zip(rows["m"], rows["x"], rows["y"]):
            if own is None:
                own = (0, 1, m, m, x, y, 0)
                continue
            seg, n, first, last, px, py, late = own
            if m < last:
                own = (*own[:-1], late + 1)
                continue
            if n == 0:  # the first after a silence
                own = (seg, 1, m, m, x, y, late)
                continue
            metres = float(metric(*(np.array([v]) for v in (px, py, x, y)))[0]) if metric else 0.0
            if keeps(metres, m - last):
                own = (seg, n + 1, first, m, x, y, late)
            else:
                out.append((key[0], seg, n, first, last, late, True))
                own = (seg + 1, 1, m, m, x, y, 0)
        if own is not None:
            state.update(own)
            if own[1]:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=COLUMNS)

    rows = points.select("mmsi", F.col("m").cast("double"), F.col("x").cast("double"), F.col("y").cast("double"))
    return rows.groupBy("mmsi").applyInPandasWithState(run, OUT, STATE, "append", "ProcessingTimeTimeout")
