"""Joins of points and intervals by key and time.

Equal keys alone would put a ship's whole history against itself, so time is cut into bins: an interval stands in every bin that it touches, and rows meet by (key, bin)
under the exact condition.  Two intervals that share several bins meet in the bin of the later begin only.  Ends are included; times are whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(width)).cast("bigint")


def _spread(df: DataFrame, begin: str, end: str, width: int) -> DataFrame:
    real = df.filter(F.col(end) >= F.col(begin))
    return real.withColumn("_bin", F.explode(F.sequence(_bin(F.col(begin), width), _bin(F.col(end), width))))


def stab(points: DataFrame, spans: DataFrame, t: str, begin: str, end: str, width: int, key: Sequence[str] = ("mmsi",), how: str = "inner") -> DataFrame:
    """Points with the intervals that hold them.  Column names other than the key's must differ."""
    a = points.withColumn("_bin", _bin(F.col(t), width))
    b = _spread(spans, begin, end, width)
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*key, "_bin")] + [F.col(f"a.{t}").between(F.col(f"b.{begin}"), F.col(f"b.{end}"))]
    out = a.alias("a").join(b.alias("b"), on, how)
    return out.select(*[F.col(f"a.{c}") for c in points.columns], *[F.col(f"b.{c}") for c in spans.columns if c not in key])


def overlap(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int, key: Sequence[str] = ("mmsi",)) -> DataFrame:
    """Pairs of intervals that share a moment, each pair once."""
    (lb, le), (rb, re) = left_span, right_span
    a, b = _spread(left, lb, le, width), _spread(right, rb, re, width)
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*key, "_bin")]
    on += [F.col(f"a.{lb}") <= F.col(f"b.{re}"), F.col(f"b.{rb}") <= F.col(f"a.{le}")]
    on += [F.col("a._bin") == _bin(F.greatest(F.col(f"a.{lb}"), F.col(f"b.{rb}")), width)]
    out = a.alias("a").join(b.alias("b"), on)
    return out.select(*[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in right.columns if c not in key])


def gather(spans: DataFrame, facts: DataFrame, span: tuple[str, str], fact_span: tuple[str, str], width: int, key: Sequence[str], aggs: dict[str, Column], on: str = "mmsi") -> DataFrame:
    """`aggs` over the facts that share a moment with each interval of `spans`, a row for each (key, interval); without any fact the aggregates see NULLs.  Facts may count
    several times, once a shared bin at most, so aggregates should not mind repetition (extremes).  One join, however many kinds of facts are united in `facts`."""
    (lb, le), (rb, re) = span, fact_span
    bins = F.when(F.col(le) >= F.col(lb), F.sequence(_bin(F.col(lb), width), _bin(F.col(le), width))).otherwise(F.array(_bin(F.col(lb), width)))
    a = spans.select(*key, lb, le).withColumn("_bin", F.explode(bins))
    b = _spread(facts, rb, re, width).withColumnsRenamed({on: "_on", "_bin": "_there"})
    touch = (F.col(on) == F.col("_on")) & (F.col("_bin") == F.col("_there")) & (F.col(lb) <= F.col(re)) & (F.col(rb) <= F.col(le)) & (F.col(le) >= F.col(lb))
    return a.join(b, touch, "left").groupBy(*key, lb, le).agg(*[v.alias(k) for k, v in aggs.items()])
