"""Driver queries: every operator on vessel tables made from the test tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline import schemas
from wakeline.functions import geo
from wakeline.functions.geodesic import footprint, geodesic
from wakeline.operators import lookups, raster, segmentation as seg, stops, tiles
from wakeline.operators.segmentation import SplitRule
from wakeline.session import shared_path
from wakeline.sources import ais_csv, events_view as view, sinks, tables, wkb

METRES, SECONDS = 300.0, 21600
BEGIN, END = 1704499200, 1705104000  # 2024-01-06 and 2024-01-13, UTC
SAMPLING, ZOOM = 20, 14
DAY_S, DAY_NS = 86_400, 86_400 * geo.NS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The vessel tables in SQL.
V = """WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS m_us, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
v AS (SELECT event_id, CAST(user_id + 200000000 AS INTEGER) AS mmsi, row_number() OVER w AS pos, m_us, m_us // 1000000 AS m, k, event_type, value / 50.0 AS sog,
  10.0::DOUBLE + CAST(sum(k % 11 - 5) OVER w AS DOUBLE) / 1000.0::DOUBLE AS x, 56.0::DOUBLE + CAST(sum(k // 11 - 4) OVER w AS DOUBLE) / 1000.0::DOUBLE AS y
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY m_us, event_id ROWS UNBOUNDED PRECEDING)),
sp AS (SELECT mmsi, m AS time_begin, coalesce(lead(m) OVER (PARTITION BY mmsi ORDER BY m_us, event_id), m) AS time_end, event_type, 1.0::DOUBLE + (k % 20) / 2.0::DOUBLE AS draught FROM v),
dim AS (SELECT CAST(c_custkey + 200000000 AS INTEGER) AS mmsi, (c_custkey % 30 + 5)::DOUBLE AS width, (c_custkey % 200 + 20)::DOUBLE AS length,
  (c_custkey % 100 + 10)::DOUBLE AS a, (c_custkey % 50 + 10)::DOUBLE AS b, (c_custkey % 15 + 2)::DOUBLE AS c, (c_custkey % 15 + 3)::DOUBLE AS d FROM customer)"""


def _haversine(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"2 * 6371008.8 * asin(sqrt(pow(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin((radians({x2}) - radians({x1})) / 2), 2)))"


def _cut(keeps: str, t: str = "m") -> str:
    return f"""{V}, p AS (SELECT *, {t} AS t, lag(x) OVER o AS px, lag(y) OVER o AS py, {t} - lag({t}) OVER o AS step_s FROM v WINDOW o AS (PARTITION BY mmsi ORDER BY {t}, pos)),
c AS (SELECT *, CASE WHEN {keeps} THEN 0 ELSE 1 END AS cut FROM p),
s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY mmsi ORDER BY t, pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS seg_id FROM c)"""


#: Vincenty's formulas on WGS84 in SQL: fixed rounds, enough for the distances of the test tables.
_FL, _AX = "(1 / 298.257223563::DOUBLE)", "6378137.0::DOUBLE"
_BX = f"({_AX} * (1 - {_FL}))"
_SERIES = f"""q_cos2a * ({_AX} * {_AX} - {_BX} * {_BX}) / ({_BX} * {_BX}) AS q_u2, 1 + q_u2 / 16384 * (4096 + q_u2 * (-768 + q_u2 * (320 - 175 * q_u2))) AS q_biga,
q_u2 / 1024 * (256 + q_u2 * (-128 + q_u2 * (74 - 47 * q_u2))) AS q_bigb"""


def _bend(sin_s: str, cos_s: str, cos_2m: str) -> str:
    return f"q_bigb * {sin_s} * ({cos_2m} + q_bigb / 4 * ({cos_s} * (2 * {cos_2m} * {cos_2m} - 1) - q_bigb / 6 * {cos_2m} * (4 * {sin_s} * {sin_s} - 3) * (4 * {cos_2m} * {cos_2m} - 3)))"


def _inverse(source: str, name: str, rounds: int = 8) -> str:
    """CTEs that add metres and azimuth from (gx1, gy1) to (gx2, gy2) to the rows of `source`."""
    step = f"""sin(q_lam) AS q_sl, cos(q_lam) AS q_cl, sqrt(pow(q_c2 * q_sl, 2) + pow(q_c1 * q_s2 - q_s1 * q_c2 * q_cl, 2)) AS q_sins, q_s1 * q_s2 + q_c1 * q_c2 * q_cl AS q_coss,
atan2(q_sins, q_coss) AS q_sigma, CASE WHEN q_sins = 0 THEN 0 ELSE q_c1 * q_c2 * q_sl / q_sins END AS q_sina, 1 - q_sina * q_sina AS q_cos2a,
CASE WHEN q_cos2a = 0 THEN 0 ELSE q_coss - 2 * q_s1 * q_s2 / q_cos2a END AS q_cos2m, {_FL} / 16 * q_cos2a * (4 + {_FL} * (4 - 3 * q_cos2a)) AS q_c,
q_span + (1 - q_c) * {_FL} * q_sina * (q_sigma + q_c * q_sins * (q_cos2m + q_c * q_coss * (2 * q_cos2m * q_cos2m - 1))) AS q_after"""
    made = "q_sl, q_cl, q_sins, q_coss, q_sigma, q_sina, q_cos2a, q_cos2m, q_c, q_after"
    start = f"""radians(gx2 - gx1) AS q_span, atan((1 - {_FL}) * tan(radians(gy1))) AS q_a1, atan((1 - {_FL}) * tan(radians(gy2))) AS q_a2,
sin(q_a1) AS q_s1, cos(q_a1) AS q_c1, sin(q_a2) AS q_s2, cos(q_a2) AS q_c2, q_span AS q_lam"""
    out = [f"{name}0 AS (SELECT *, {start} FROM {source})"]
    for i in range(rounds):
        out.append(f"{name}{i + 1} AS (SELECT * EXCLUDE (q_lam, {made}), q_after AS q_lam FROM (SELECT *, {step} FROM {name}{i}))")
    out.append(f"""{name} AS (SELECT * EXCLUDE (q_span, q_a1, q_a2, q_s1, q_c1, q_s2, q_c2, q_lam, {made}, q_u2, q_biga, q_bigb), CASE WHEN gx1 = gx2 AND gy1 = gy2 THEN 0 ELSE {_BX} * q_biga * (q_sigma - {_bend('q_sins', 'q_coss', 'q_cos2m')}) END AS metres,
CASE WHEN gx1 = gx2 AND gy1 = gy2 THEN 0 ELSE atan2(q_c2 * q_sl, q_c1 * q_s2 - q_s1 * q_c2 * q_cl) END AS azimuth FROM (SELECT *, {step}, {_SERIES} FROM {name}{rounds}))""")
    return ", ".join(out)


def _direct(source: str, name: str, rounds: int = 6) -> str:
    """CTEs that add the point (ox, oy) that lies `off` metres from (gx1, gy1) in the direction `azimuth`.  One CTE a round: aliases within one would be written out again and again."""
    out = [f"""{name}_ AS (SELECT *, atan((1 - {_FL}) * tan(radians(gy1))) AS q_a1, sin(azimuth) AS q_sa, cos(azimuth) AS q_ca FROM {source}),
{name}0 AS (SELECT *, off / ({_BX} * q_biga) AS q_plain, off / ({_BX} * q_biga) AS q_t FROM (SELECT *, {_SERIES} FROM (SELECT *, 1 - q_sina * q_sina AS q_cos2a FROM
(SELECT *, sin(q_a1) AS q_s1, cos(q_a1) AS q_c1, atan2(tan(q_a1), q_ca) AS q_first, cos(q_a1) * q_sa AS q_sina FROM {name}_))))"""]
    turn = "sin(q_t) AS q_ss, cos(q_t) AS q_cs, cos(2 * q_first + q_t) AS q_cos2m"
    for i in range(rounds):
        out.append(f"{name}{i + 1} AS (SELECT * EXCLUDE (q_t, q_ss, q_cs, q_cos2m), q_plain + {_bend('q_ss', 'q_cs', 'q_cos2m')} AS q_t FROM (SELECT *, {turn} FROM {name}{i}))")
    out.append(f"""{name} AS (SELECT mmsi, pos, p, degrees(atan2(q_s1 * q_cs + q_c1 * q_ss * q_ca, (1 - {_FL}) * sqrt(q_sina * q_sina + pow(q_s1 * q_ss - q_c1 * q_cs * q_ca, 2)))) AS oy,
gx1 + degrees(atan2(q_ss * q_sa, q_c1 * q_cs - q_s1 * q_ss * q_ca) - (1 - q_c) * {_FL} * q_sina * (q_t + q_c * q_ss * (q_cos2m + q_c * q_cs * (2 * q_cos2m * q_cos2m - 1)))) AS ox
FROM (SELECT *, {turn}, {_FL} / 16 * q_cos2a * (4 + {_FL} * (4 - 3 * q_cos2a)) AS q_c FROM {name}{rounds}))""")
    return ", ".join(out)


_SUMMARY = " SELECT mmsi, seg_id, count(*) AS n_points, min(t) AS m_first, max(t) AS m_last FROM s GROUP BY mmsi, seg_id"
_TIME = SplitRule(None, SECONDS)
_BOTH = SplitRule(METRES, SECONDS, "haversine")


@query(_cut(f"step_s < {SECONDS}") + _SUMMARY)
def seg_time_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.summaries(seg.segment(view.points(spark, sf_dir), _TIME))


@query(_cut(f"step_s < {SECONDS}", "(m_us / 1000000.0::DOUBLE)") + """ SELECT mmsi, seg_id, CAST(floor(min(t)) AS BIGINT) AS t_start_s,
CASE WHEN count(*) = 1 THEN 0 ELSE CAST(ceil(max(t)) AS BIGINT) - CAST(floor(min(t)) AS BIGINT) END AS duration_s FROM s GROUP BY mmsi, seg_id""")
def seg_intervals(spark, sf_dir):
    return seg.intervals(seg.segment(view.points(spark, sf_dir).withColumn("m", F.col("m_us") / 1e6), _TIME))


@query(_cut(f"{_haversine('px', 'py', 'x', 'y')} < {METRES} AND step_s < {SECONDS}") + _SUMMARY)
def seg_haversine(spark, sf_dir):
    return seg.summaries(seg.segment(view.points(spark, sf_dir), _BOTH))


@query(_cut(f"{_haversine('px', 'py', 'x', 'y')} < {METRES} AND step_s < {SECONDS}") + " SELECT event_id, mmsi, seg_id FROM s")
def seg_in_parts(spark, sf_dir):
    return seg.segment_in_parts(view.points(spark, sf_dir), _BOTH, 7 * DAY_S).select("event_id", "mmsi", "seg_id")


@query(_cut(f"{_haversine('px', 'py', 'x', 'y')} <= {METRES} OR step_s <= {SECONDS}") + _SUMMARY)
def seg_either(spark, sf_dir):
    return seg.summaries(seg.segment(view.points(spark, sf_dir), SplitRule(METRES, SECONDS, "haversine", "<=", "or")))


_STEPS = V + ", f AS (SELECT *, lag(x) OVER o AS gx1, lag(y) OVER o AS gy1, x AS gx2, y AS gy2, m - lag(m) OVER o AS step_s FROM v WINDOW o AS (PARTITION BY mmsi ORDER BY m, pos)), " + _inverse("f", "g")


def _geodesic_cut(metres: float, seconds: int) -> str:
    return _STEPS + f""", s AS (SELECT *, m AS t, CAST(sum(CASE WHEN metres < {metres} AND step_s < {seconds} THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi ORDER BY m, pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS seg_id FROM g)"""


@query(_geodesic_cut(METRES, SECONDS) + _SUMMARY)
def seg_geodesic(spark, sf_dir):
    return seg.summaries(seg.segment(view.points(spark, sf_dir), SplitRule(METRES, SECONDS)))


@query(_geodesic_cut(1000.0, 60) + _SUMMARY)
def seg_default(spark, sf_dir):
    """The rule of the production job, which is the default, where all vertices are 600 times as close in time."""
    return seg.summaries(seg.segment(view.points(spark, sf_dir), SplitRule()))


@query(_cut("true") + f""", h AS (SELECT mmsi, {_haversine('px', 'py', 'x', 'y')} AS step_m FROM s), l AS (SELECT unnest([4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0, 1024.0, 2048.0])::DOUBLE AS threshold)
SELECT mmsi, threshold, count(*) AS total_len, count(*) FILTER (step_m >= threshold) + 1 AS num_splits, count(*) // (count(*) FILTER (step_m >= threshold) + 1) AS avg_subtraj_len FROM h, l GROUP BY mmsi, threshold""")
def seg_threshold_sweep(spark, sf_dir):
    return seg.threshold_sweep(view.points(spark, sf_dir).filter(lookups.valid_mmsi()), seg.thresholds())


@query(f"{V} SELECT mmsi, count(*) AS n_before, count(*) AS n_after, true AS valid FROM v GROUP BY mmsi")
def seg_roundtrip(spark, sf_dir):
    points = view.points(spark, sf_dir)
    whole = seg.concatenated(seg.pieces(seg.segment(points, _BOTH))).select("mmsi", F.size("coords").cast("bigint").alias("n_after"), "valid")
    return points.groupBy("mmsi").agg(F.count("*").alias("n_before")).join(whole, "mmsi").select("mmsi", "n_before", "n_after", "valid")


@query(_cut(f"step_s < {SECONDS}") + " SELECT mmsi, seg_id, CASE WHEN count(*) = 1 THEN 'point' ELSE 'sub' END AS kind, count(*) AS n_points FROM s GROUP BY mmsi, seg_id")
def seg_kinds(spark, sf_dir):
    return seg.pieces(seg.segment(view.points(spark, sf_dir), _TIME)).select("mmsi", "seg_id", "kind", F.size("coords").cast("bigint").alias("n_points"))


@query(f"{V} SELECT mmsi, count(*) AS n_points, min(m) AS m_min, max(m) AS m_max FROM v WHERE m BETWEEN {BEGIN} AND {END} GROUP BY mmsi")
def traj_time_clip(spark, sf_dir):
    return seg.clip(view.points(spark, sf_dir), BEGIN + 0.7, END + 0.7).groupBy("mmsi").agg(F.count("*").alias("n_points"), F.min("m").alias("m_min"), F.max("m").alias("m_max"))


@query(f"{V} SELECT event_id, mmsi, m, sog FROM v WHERE m_us BETWEEN {BEGIN}000000 AND {END}000000")
def point_scan_window(spark, sf_dir):
    samples = view.points(spark, sf_dir).withColumn("timestamp", F.timestamp_micros("m_us"))
    return tables.at_times(samples, BEGIN, END).select("event_id", "mmsi", "m", "sog")


@query(f"{V} SELECT mmsi, time_begin, time_end, event_type, draught FROM sp WHERE time_end >= {BEGIN} AND time_begin <= {END}")
def interval_scan_window(spark, sf_dir):
    spans = view.spans(view.points(spark, sf_dir)).withColumns({"b": F.timestamp_seconds("time_begin"), "e": F.timestamp_seconds("time_end")})
    return tables.meeting(spans, BEGIN, END, "b", "e").drop("b", "e")


@query(f"{V} SELECT mmsi, width, length FROM dim WHERE mmsi IN (SELECT mmsi FROM v)")
def dims_semi(spark, sf_dir):
    return lookups.members(view.dimensions(spark, sf_dir), view.points(spark, sf_dir)).select("mmsi", "width", "length")


@query(f"""{V}, t AS (SELECT * FROM v WHERE m BETWEEN {BEGIN} AND {END}) SELECT 'trajectories' AS name, count(*) AS n FROM t UNION ALL
SELECT 'sog', count(*) FROM v WHERE m_us BETWEEN {BEGIN}000000 AND {END}000000 UNION ALL SELECT 'draught', count(*) FROM sp WHERE time_end >= {BEGIN} AND time_begin <= {END} UNION ALL
SELECT 'dimensions', count(*) FROM dim WHERE mmsi IN (SELECT mmsi FROM t) UNION ALL SELECT 'gps_position', count(*) FROM dim WHERE mmsi IN (SELECT mmsi FROM t)""")
def ships_window(spark, sf_dir):
    points, dims = view.points(spark, sf_dir), view.dimensions(spark, sf_dir)
    spans = view.spans(points).select("mmsi", F.timestamp_seconds("time_begin").alias("time_begin"), F.timestamp_seconds("time_end").alias("time_end"), "draught")
    ships = tables.Ships({
        "trajectories": points, "sog": points.select("mmsi", F.timestamp_micros("m_us").alias("timestamp"), "sog"), "draught": spans,
        "dimensions": dims.select("mmsi", "width", "length"), "gps_position": dims.select("mmsi", "a", "b", "c", "d"),
    }).window(BEGIN, END)
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in ships.tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f"{V} SELECT DISTINCT mmsi FROM v")
def distinct_mmsi(spark, sf_dir):
    return view.points(spark, sf_dir).select("mmsi").distinct()


@query(f"{V} SELECT mmsi, length(CAST(mmsi AS VARCHAR)) = 9 AS valid FROM dim")
def valid_mmsi(spark, sf_dir):
    return view.dimensions(spark, sf_dir).select("mmsi", lookups.valid_mmsi().alias("valid"))


@query(f"{V} SELECT mmsi FROM dim ORDER BY mmsi LIMIT 50 OFFSET 100")
def page_scan(spark, sf_dir):
    return tables.page(view.dimensions(spark, sf_dir).select("mmsi"), 2, 50)


@query(f"{V} SELECT mmsi, (row_number() OVER (ORDER BY mmsi) - 1) // 50 AS page FROM (SELECT DISTINCT mmsi FROM dim)")
def page_numbers(spark, sf_dir):
    return tables.ship_pages(view.dimensions(spark, sf_dir), 50)


@query(f"{V} SELECT count(*) AS n FROM (SELECT DISTINCT mmsi FROM v)")
def traj_count(spark, sf_dir):
    return view.points(spark, sf_dir).select("mmsi").distinct().agg(F.count("*").alias("n"))


_LINES = f"{V}, l AS (SELECT mmsi, pos, m, x, y, k, sog, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(m) OVER o AS m2, lead(x, 2) OVER o AS x3, lead(y, 2) OVER o AS y3 FROM v WINDOW o AS (PARTITION BY mmsi ORDER BY m, pos))"


@query(_LINES + " SELECT mmsi, pos, x, y, m, x2, y2, m2 FROM l WHERE m2 IS NOT NULL")
def traj_lines(spark, sf_dir):
    return seg.lines(view.points(spark, sf_dir)).select("mmsi", "pos", "x", "y", "m", "x2", "y2", "m2")


@query(f"{V}, f AS (SELECT mmsi, CASE WHEN k < lag(k) OVER (PARTITION BY mmsi ORDER BY pos) THEN 1 ELSE 0 END AS falls FROM v) SELECT mmsi, count(*) AS n_points, CAST(sum(falls) + CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_violations FROM f GROUP BY mmsi")
def traj_validate(spark, sf_dir):
    return seg.violations(view.points(spark, sf_dir).withColumn("m", F.col("k")))


@query("SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'Moored' WHEN 'view' THEN 'UnderWayUsingEngine' WHEN 'purchase' THEN 'AtAnchor' WHEN 'signup' THEN 'Aground' WHEN 'error' THEN 'EngagedInFishing' END AS status FROM events")
def nav_status_map(spark, sf_dir):
    types = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    named = types.replace(view.STATUS, subset=["event_type"]).withColumn("status", lookups.nav_status(F.initcap("event_type")))
    return named.replace({v: k for k, v in view.STATUS.items()}, subset=["event_type"]).select("event_type", "status")


@query(f"{V}, f AS (SELECT mmsi, m, min(struct_pack(e := event_id, s := sog)) AS b FROM v GROUP BY mmsi, m) SELECT v.event_id, f.b.s AS sog_at FROM v JOIN f ON v.mmsi = f.mmsi AND v.m = f.m")
def lookup_exact(spark, sf_dir):
    points = view.points(spark, sf_dir)
    samples = points.select("mmsi", "m", F.col("event_id").alias("seq"), F.col("sog").alias("sog_at"))
    return lookups.at_time(points.select("event_id", "mmsi", "m"), samples, order=["seq"]).select("event_id", "sog_at")


@query(f"""{V}, j AS (SELECT v.event_id, sp.draught, sp.event_type, row_number() OVER (PARTITION BY v.event_id ORDER BY time_begin, time_end, sp.event_type, draught) AS n
FROM v JOIN sp ON v.mmsi = sp.mmsi AND v.m + 1 BETWEEN time_begin AND time_end) SELECT event_id, draught, event_type FROM j WHERE n = 1""")
def lookup_stab(spark, sf_dir):
    points = view.points(spark, sf_dir)
    asks = points.select("event_id", "mmsi", (F.col("m") + 1).alias("t"))
    return lookups.holding(asks, view.spans(points), "t", "time_begin", "time_end", DAY_S, ["event_id"]).select("event_id", "draught", "event_type")


@query(f"{V} SELECT v.event_id, count(*) AS n, max(draught) AS max_draught FROM v JOIN sp ON v.mmsi = sp.mmsi AND v.m <= time_end AND time_begin <= v.m + {DAY_S} GROUP BY v.event_id")
def lookup_overlap(spark, sf_dir):
    points = view.points(spark, sf_dir)
    asks = points.select("event_id", "mmsi", F.col("m").alias("f"), (F.col("m") + DAY_S).alias("t"))
    found = lookups.overlapping(asks, view.spans(points).drop("event_type"), ("f", "t"), ("time_begin", "time_end"), DAY_S)
    return found.groupBy("event_id").agg(F.count("*").alias("n"), F.max("draught").alias("max_draught"))


@query(f"""{V}, d AS (SELECT mmsi, m, max(struct_pack(e := event_id, s := sog)) AS b FROM v GROUP BY mmsi, m)
SELECT v.event_id, count(*) AS n, min(d.b.s) AS min_sog, max(d.b.s) AS max_sog FROM v JOIN d ON v.mmsi = d.mmsi AND d.m BETWEEN v.m AND v.m + {DAY_S} GROUP BY v.event_id""")
def lookup_sog_range(spark, sf_dir):
    points = view.points(spark, sf_dir)
    asks = points.select("event_id", "mmsi", F.col("m").alias("f"), (F.col("m") + DAY_S).alias("e"))
    samples = points.select("mmsi", F.col("m").alias("t"), F.col("event_id").alias("seq"), "sog")
    found = lookups.between(asks, samples, "t", "f", "e", DAY_S, "seq")
    return found.groupBy("event_id").agg(F.count("*").alias("n"), F.min("sog").alias("min_sog"), F.max("sog").alias("max_sog"))


@query(f"{V} SELECT s.mmsi, width, length FROM (SELECT DISTINCT mmsi FROM v) s LEFT JOIN dim ON s.mmsi = dim.mmsi")
def lookup_dims(spark, sf_dir):
    dims = view.dimensions(spark, sf_dir).select("mmsi", "width", "length")
    return lookups.by_ship(view.points(spark, sf_dir).select("mmsi").distinct(), dims, ("length", "width")).select("mmsi", "width", "length")


@query(f"{V} SELECT s.mmsi, a, b, c, d FROM (SELECT DISTINCT mmsi FROM v) s JOIN dim ON s.mmsi = dim.mmsi")
def lookup_gps(spark, sf_dir):
    gps = view.dimensions(spark, sf_dir).select("mmsi", "a", "b", "c", "d")
    return lookups.by_ship(view.points(spark, sf_dir).select("mmsi").distinct(), gps, ("a", "b", "c", "d"), "inner").select("mmsi", "a", "b", "c", "d")


@query(f"{V} SELECT mmsi, pos, x, y, m FROM v WHERE mmsi = 200000007")
def lookup_traj(spark, sf_dir):
    return view.points(spark, sf_dir).filter("mmsi = 200000007").select("mmsi", "pos", "x", "y", "m")


@query(f"{V} SELECT event_id, CASE WHEN k % 5 < 2 THEN k // 20 END AS cluster_id FROM v")
def label_clusters(spark, sf_dir):
    rows = view.points(spark, sf_dir).withColumns({"label": F.when(F.col("k") % 5 == 0, "core").when(F.col("k") % 5 == 1, "edge").otherwise("noise"), "cluster": F.expr("k div 20")})
    return rows.select("event_id", lookups.cluster_of("label", "cluster").alias("cluster_id"))


@query(_LINES + " SELECT mmsi, pos, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS dist FROM l WHERE m2 IS NOT NULL")
def dist_euclid(spark, sf_dir):
    return seg.lines(view.points(spark, sf_dir)).select("mmsi", "pos", geo.euclidean("x", "y", "x2", "y2").alias("dist"))


@query(_LINES + f" SELECT mmsi, pos, round({_haversine('x', 'y', 'x2', 'y2')}, 3) AS dist FROM l WHERE m2 IS NOT NULL")
def dist_haversine(spark, sf_dir):
    return seg.lines(view.points(spark, sf_dir)).select("mmsi", "pos", F.round(geo.haversine("x", "y", "x2", "y2"), 3).alias("dist"))


@query(_LINES + ", f AS (SELECT mmsi, pos, x AS gx1, y AS gy1, x2 AS gx2, y2 AS gy2 FROM l WHERE m2 IS NOT NULL), " + _inverse("f", "g") + " SELECT mmsi, pos, round(metres, 3) AS dist FROM g")
def dist_geodesic(spark, sf_dir):
    return seg.lines(view.points(spark, sf_dir)).select("mmsi", "pos", F.round(geodesic("x", "y", "x2", "y2"), 3).alias("dist"))


def _grid(zoom: int, x: str, y: str) -> tuple[str, str]:
    return (
        f"CAST(floor(pow(2.0::DOUBLE, {zoom}) / (2 * pi()) * (pi() + radians({x}))) AS BIGINT)",
        f"CAST(floor(pow(2.0::DOUBLE, {zoom}) / (2 * pi()) * (pi() - ln(tan(pi() / 4 + radians({y}) / 2)))) AS BIGINT)",
    )


_GX, _GY = _grid(16, "x", "y")


@query(f"{V} SELECT event_id, {_GX} AS gx, {_GY} AS gy FROM v")
def grid_cells(spark, sf_dir):
    return view.points(spark, sf_dir).select("event_id", geo.grid_x("x", F.lit(16)).alias("gx"), geo.grid_y("y", F.lit(16)).alias("gy"))


@query(f"{V} SELECT event_id, {_GX} // 64 AS cx, {_GY} // 64 AS cy, {_GX} * 4 AS fx, {_GY} * 4 AS fy, (k - 50) // 8 AS neg FROM v")
def rezoom(spark, sf_dir):
    g = grid_cells(spark, sf_dir).join(view.points(spark, sf_dir).select("event_id", "k"), "event_id")
    at = lambda c, z: geo.rezoom(c, F.lit(16), F.lit(z))
    return g.select("event_id", at("gx", 10).alias("cx"), at("gy", 10).alias("cy"), at("gx", 18).alias("fx"), at("gy", 18).alias("fy"), geo.rezoom(F.col("k") - 50, F.lit(16), F.lit(13)).alias("neg"))


def _cell(x1: str, y1: str, x2: str, y2: str) -> tuple[str, str, str]:
    """n, x, y of raster cell k."""
    ax, ay = f"abs({x2} - {x1})", f"abs({y2} - {y1})"
    n, mi = f"greatest({ax}, {ay})", f"least({ax}, {ay})"
    side = f"(CASE WHEN {n} = 0 THEN 0 ELSE (k * {mi} - {n} // 2 + {n} - 1) // {n} END)"
    return (
        n,
        f"({x1} + (CASE WHEN {x2} < {x1} THEN -1 ELSE 1 END) * (CASE WHEN {ax} > {ay} THEN k ELSE {side} END))",
        f"({y1} + (CASE WHEN {y2} < {y1} THEN -1 ELSE 1 END) * (CASE WHEN {ax} > {ay} THEN {side} ELSE k END))",
    )


def _raster(zoom: int) -> str:
    (gx, gy), (hx, hy) = _grid(zoom, "x", "y"), _grid(zoom, "x2", "y2")
    n, cx, cy = _cell("x1", "y1", "xe", "ye")
    return _LINES + f""", g AS (SELECT mmsi, pos, {gx} AS x1, {gy} AS y1, {hx} AS xe, {hy} AS ye, m * 1000000000 AS t0, m2 * 1000000000 AS t1 FROM l WHERE m2 IS NOT NULL),
gk AS (SELECT *, {n} AS n, unnest(range(0, {n} + 1)) AS k FROM g),
gc AS (SELECT mmsi, pos, k, n, t0, t1, {cx} AS cell_x, {cy} AS cell_y FROM gk)"""


@query(_raster(16) + " SELECT mmsi, pos, k, cell_x, cell_y FROM gc")
def bresenham(spark, sf_dir):
    z = F.lit(16)
    ends = seg.lines(view.points(spark, sf_dir)).select("mmsi", "pos", geo.grid_x("x", z).alias("x1"), geo.grid_y("y", z).alias("y1"), geo.grid_x("x2", z).alias("x2"), geo.grid_y("y2", z).alias("y2"))
    return raster.line_cells(ends, keep=("mmsi", "pos")).select("mmsi", "pos", "k", "cell_x", "cell_y")


_SCALE = 2 ** (SAMPLING - ZOOM)
_SPREAD = _raster(SAMPLING) + f""", cells AS (SELECT mmsi, cell_x // {_SCALE} AS x, cell_y // {_SCALE} AS y, {ZOOM} AS z,
  greatest(t0, t0 + k * ((t1 - t0) // n) - ((t1 - t0) // n) // 2) AS t_begin_ns, least(t1, t0 + k * ((t1 - t0) // n) + ((t1 - t0) // n) // 2 + 1) AS t_end_ns FROM gc WHERE n > 0)"""
_UNION = _SPREAD + """, i1 AS (SELECT *, max(t_end_ns) OVER (PARTITION BY mmsi, x, y ORDER BY t_begin_ns, t_end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM cells),
i2 AS (SELECT *, sum(CASE WHEN so_far >= t_begin_ns THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi, x, y ORDER BY t_begin_ns, t_end_ns ROWS UNBOUNDED PRECEDING) AS island FROM i1),
iv AS (SELECT mmsi, x, y, z, min(t_begin_ns) AS t_begin_ns, max(t_end_ns) AS t_end_ns FROM i2 GROUP BY mmsi, x, y, z, island)"""
_TILES = _UNION + """, sg AS (SELECT mmsi, m * 1000000000 AS t, max(struct_pack(e := event_id, s := sog)) AS b FROM v GROUP BY mmsi, m),
speed AS (SELECT iv.mmsi, x, y, min(b.s) AS min_sog, max(b.s) AS max_sog FROM iv JOIN sg ON iv.mmsi = sg.mmsi AND t BETWEEN t_begin_ns AND t_end_ns GROUP BY iv.mmsi, x, y),
deep AS (SELECT iv.mmsi, x, y, max(draught) AS max_draught FROM iv JOIN sp ON iv.mmsi = sp.mmsi AND t_begin_ns <= time_end * 1000000000 AND time_begin * 1000000000 <= t_end_ns GROUP BY iv.mmsi, x, y),
oc AS (SELECT mmsi, x, y, z, CAST(sum(t_end_ns - t_begin_ns) AS BIGINT) AS cell_oc_ns FROM iv GROUP BY mmsi, x, y, z),
st AS (SELECT oc.mmsi, oc.x, oc.y, oc.z, max_draught, 1::BIGINT AS distinct_ship_count, min_sog, max_sog, cell_oc_ns, length AS min_length, length AS max_length, width AS min_width, width AS max_width
  FROM oc LEFT JOIN speed USING (mmsi, x, y) LEFT JOIN deep USING (mmsi, x, y) LEFT JOIN dim USING (mmsi))"""
_MERGE = "max(max_draught) AS max_draught, {ships} AS distinct_ship_count, min(min_sog) AS min_sog, max(max_sog) AS max_sog, CAST(sum(cell_oc_ns) AS BIGINT) AS cell_oc_ns, min(min_length) AS min_length, max(max_length) AS max_length, min(min_width) AS min_width, max(max_width) AS max_width"


def _cells(spark, sf_dir) -> DataFrame:
    return raster.linestring_cells(view.points(spark, sf_dir), ZOOM, SAMPLING)


@query(_SPREAD + " SELECT * FROM cells")
def raster_spread(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(_UNION + " SELECT mmsi, x, y, z, t_begin_ns, t_end_ns FROM iv")
def interval_union(spark, sf_dir):
    return tiles.union_intervals(_cells(spark, sf_dir), ("mmsi", "x", "y", "z"))


@query(_TILES + " SELECT * FROM st")
def ship_tiles(spark, sf_dir):
    points = view.points(spark, sf_dir)
    sog = points.select("mmsi", (F.col("m") * geo.NS).alias("t_ns"), F.col("event_id").alias("seq"), "sog")
    draught = view.spans(points).select("mmsi", (F.col("time_begin") * geo.NS).alias("d_begin_ns"), (F.col("time_end") * geo.NS).alias("d_end_ns"), "draught")
    return tiles.ship_tiles(_cells(spark, sf_dir), sog, draught, view.dimensions(spark, sf_dir), DAY_NS)


@query(_TILES + f" SELECT x, y, z, {_MERGE.format(ships='CAST(sum(distinct_ship_count) AS BIGINT)')} FROM st GROUP BY x, y, z")
def tile_heatmap(spark, sf_dir):
    return tiles.narrow(tiles.combine(ship_tiles(spark, sf_dir)))


@query(_TILES + f" SELECT x // 4 AS x, y // 4 AS y, {ZOOM - 2} AS z, {_MERGE.format(ships='CAST(sum(distinct_ship_count) AS BIGINT)')} FROM st GROUP BY x // 4, y // 4")
def tile_rezoom(spark, sf_dir):
    return tiles.narrow(tiles.combine(tiles.rezoom(ship_tiles(spark, sf_dir), ZOOM - 2)))


@query(_TILES + f""", zs AS (SELECT unnest([{ZOOM}, {ZOOM - 2}, {ZOOM - 4}]) AS z2), zt AS (SELECT st.* EXCLUDE (x, y, z), CAST(st.x // pow(2, {ZOOM} - z2)::BIGINT AS BIGINT) AS x, CAST(st.y // pow(2, {ZOOM} - z2)::BIGINT AS BIGINT) AS y, z2 AS z FROM st, zs)
SELECT x, y, z, {_MERGE.format(ships='count(DISTINCT mmsi)')} FROM zt GROUP BY x, y, z""")
def tile_pyramid(spark, sf_dir):
    return tiles.narrow(tiles.pyramid(ship_tiles(spark, sf_dir), [ZOOM, ZOOM - 2, ZOOM - 4]))


_TRI = _LINES + ", t AS (SELECT mmsi, pos, " + ", ".join(f"{g} AS {c}{i}" for i, (x, y) in enumerate((("x", "y"), ("x2", "y2"), ("x3", "y3")), 1) for c, g in zip("xy", _grid(16, x, y))) + " FROM l WHERE x3 IS NOT NULL)"


def _triangles(spark, sf_dir) -> DataFrame:
    w, z = Window.partitionBy("mmsi").orderBy("m", "pos"), F.lit(16)
    rows = view.points(spark, sf_dir).withColumns({f"{c}{i}": F.lead(c, i - 1).over(w) for i in (2, 3) for c in "xy"}).filter("x3 IS NOT NULL")
    cols = {f"{c}{i}": (geo.grid_x if c == "x" else geo.grid_y)(f"{c}{i}" if i > 1 else c, z) for i in (1, 2, 3) for c in "xy"}
    return rows.select("mmsi", "pos", *[v.alias(k) for k, v in cols.items()])


def _area(*p: str) -> str:
    (ax, ay), (bx, by), (cx, cy) = zip(p[::2], p[1::2])
    return f"(0.5::DOUBLE * (({by} - {ay}) * ({bx} + {ax}) + ({cy} - {by}) * ({cx} + {bx}) + ({ay} - {cy}) * ({ax} + {cx}))::DOUBLE)"


_CORNERS = ("x1", "y1", "x2", "y2", "x3", "y3")


@query(_TRI + f" SELECT mmsi, pos, {_area(*_CORNERS)} AS area, least(x1, x2, x3) AS min_x, greatest(y1, y2, y3) AS max_y FROM t")
def tri_area(spark, sf_dir):
    left, _, _, top = geo.bounding_box(["x1", "x2", "x3"], ["y1", "y2", "y3"])
    return _triangles(spark, sf_dir).select("mmsi", "pos", geo.triangle_area(*_CORNERS).alias("area"), left.alias("min_x"), top.alias("max_y"))


@query(_TRI + f""", a AS (SELECT *, {_area(*_CORNERS)} AS area, unnest(range(least(x1, x2, x3), greatest(x1, x2, x3) + 1)) AS cell_x FROM t), b AS (SELECT *, unnest(range(least(y1, y2, y3), greatest(y1, y2, y3) + 1)) AS cell_y FROM a WHERE area <> 0),
c AS (SELECT mmsi, pos, cell_x, cell_y, {_area('cell_x', 'cell_y', 'x2', 'y2', 'x3', 'y3')} / area AS alpha, {_area('cell_x', 'cell_y', 'x3', 'y3', 'x1', 'y1')} / area AS beta, {_area('cell_x', 'cell_y', 'x1', 'y1', 'x2', 'y2')} / area AS gamma FROM b)
SELECT * FROM c WHERE alpha >= 0 AND beta >= 0 AND gamma >= 0""")
def tri_raster(spark, sf_dir):
    return raster.triangle_cells(_triangles(spark, sf_dir), ("mmsi", "pos"))


_PROBE = _LINES + """, b AS (SELECT *, 0.5::DOUBLE * x + 0.25::DOUBLE * x2 + 0.25::DOUBLE * x3 AS px, 0.5::DOUBLE * y + 0.25::DOUBLE * y2 + 0.25::DOUBLE * y3 AS py FROM l WHERE x3 IS NOT NULL),
r AS (SELECT *, CASE WHEN x2 = x AND y2 = y THEN 0.0::DOUBLE ELSE ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) END AS ratio, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) * 100000.0::DOUBLE AS metres FROM b),
o AS (SELECT *, CAST(trunc((m2 - m) * ratio) AS BIGINT) + m AS probe FROM r)"""


def _probe(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("mmsi").orderBy("m", "pos")
    rows = view.points(spark, sf_dir).withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w), "m2": F.lead("m").over(w), "x3": F.lead("x", 2).over(w), "y3": F.lead("y", 2).over(w)}).filter("x3 IS NOT NULL")
    px, py = geo.from_barycentric(F.lit(0.5), F.lit(0.25), F.lit(0.25), "x", "y", "x2", "y2", "x3", "y3")
    rows = rows.withColumns({"px": px, "py": py})
    return rows.withColumns({"ratio": geo.probe_ratio("px", "py", "x", "y", "x2", "y2"), "metres": geo.length(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")) * 100000.0})


@query(_PROBE + " SELECT mmsi, pos, round(px, 9) AS px, round(py, 9) AS py, round(ratio, 6) AS ratio, probe AS probe_s FROM o")
def probe_math(spark, sf_dir):
    return _probe(spark, sf_dir).select("mmsi", "pos", F.round("px", 9).alias("px"), F.round("py", 9).alias("py"), F.round("ratio", 6).alias("ratio"), geo.probe_second("m", "m2", "ratio").alias("probe_s"))


@query(_PROBE + """ SELECT mmsi, pos, CASE WHEN metres = 0 THEN probe ELSE probe - CAST(trunc((m2 - m) / metres * 60.0::DOUBLE) AS BIGINT) END AS begin_s,
CASE WHEN metres = 0 THEN probe + (m2 - m) ELSE probe + CAST(trunc((m2 - m) / metres * 25.0::DOUBLE) AS BIGINT) END AS end_s FROM o""")
def occupation(spark, sf_dir):
    begin, end = geo.occupation("m", "m2", "metres", "ratio", F.lit(60.0), F.lit(25.0))
    return _probe(spark, sf_dir).select("mmsi", "pos", begin.alias("begin_s"), end.alias("end_s"))


@query(_LINES + " SELECT mmsi, pos, CASE WHEN k % 4 = 0 THEN m2 - m ELSE (m2 - m) // (k % 4) END AS share FROM l WHERE m2 IS NOT NULL")
def time_share(spark, sf_dir):
    return seg.lines(view.points(spark, sf_dir)).select("mmsi", "pos", geo.time_share("m", "m2", F.col("k") % 4).alias("share"))


def _ends(spark, sf_dir) -> DataFrame:
    return seg.lines(view.points(spark, sf_dir)).join(view.dimensions(spark, sf_dir), "mmsi")


_CORNER = "SELECT mmsi, pos, x, y, m, x2, y2, m2, a, b, '{p}' AS p, {x} AS gx1, {y} AS gy1, {x} {s} (y2 - y) AS gx2, {y} {t} (x2 - x) AS gy2, {off}::DOUBLE AS off FROM ends"
_FOOTPRINT = (
    _LINES + ", ends AS (SELECT mmsi, pos, x, y, m, x2, y2, m2, a, b, c, d FROM l JOIN dim USING (mmsi) WHERE m2 IS NOT NULL), cn AS ("
    + " UNION ALL ".join(_CORNER.format(p=p, x=x, y=y, s=s, t=t, off=off) for p, x, y, s, t, off in (("a", "x", "y", "-", "+", "c"), ("b", "x2", "y2", "-", "+", "c"), ("c", "x", "y", "+", "-", "d"), ("d", "x2", "y2", "+", "-", "d")))
    + "), " + _inverse("cn", "ia") + ", " + _direct("ia", "cd")
    + ", fp AS (SELECT mmsi, pos, " + ", ".join(f"max(o{c}) FILTER (p = '{p}') AS f_{p}{c}" for p in "abcd" for c in "xy") + " FROM cd GROUP BY mmsi, pos)"
)


@query(_FOOTPRINT + " SELECT mmsi, pos, " + ", ".join(f"round(f_{p}{c}, 7) AS \"{p}{c}\"" for p in "abcd" for c in "xy") + " FROM fp")
def footprint_corners(spark, sf_dir):
    return _ends(spark, sf_dir).select("mmsi", "pos", footprint("x", "y", "x2", "y2", "c", "d").alias("f")).select("mmsi", "pos", *[F.round(f"f.{p}{c}", 7).alias(p + c) for p in "abcd" for c in "xy"])


_PART = "SELECT mmsi, pos, " + ", ".join(f"f_{{{i}}}{c} AS t{c}{i + 1}" for i in range(3) for c in "xy") + " FROM fp"
_COVERED = (
    _FOOTPRINT + ", tp AS (" + _PART.format("a", "c", "b") + " UNION ALL " + _PART.format("c", "b", "d") + "), t AS (SELECT *, "
    + ", ".join(f"{g} AS {c}{i}" for i in (1, 2, 3) for c, g in zip("xy", _grid(16, f"tx{i}", f"ty{i}"))) + " FROM tp)"
    + f""", w1 AS (SELECT *, {_area(*_CORNERS)} AS area, unnest(range(least(x1, x2, x3), greatest(x1, x2, x3) + 1)) AS cell_x FROM t), w2 AS (SELECT *, unnest(range(least(y1, y2, y3), greatest(y1, y2, y3) + 1)) AS cell_y FROM w1 WHERE area <> 0),
w3 AS (SELECT *, {_area('cell_x', 'cell_y', 'x2', 'y2', 'x3', 'y3')} / area AS alpha, {_area('cell_x', 'cell_y', 'x3', 'y3', 'x1', 'y1')} / area AS beta, {_area('cell_x', 'cell_y', 'x1', 'y1', 'x2', 'y2')} / area AS gamma FROM w2),
w4 AS (SELECT mmsi, pos, cell_x, cell_y, alpha * tx1 + beta * tx2 + gamma * tx3 AS px, alpha * ty1 + beta * ty2 + gamma * ty3 AS py FROM w3 WHERE alpha >= 0 AND beta >= 0 AND gamma >= 0),
w5 AS (SELECT w4.*, m, m2, a, b, x AS gx1, y AS gy1, ends.x2 AS gx2, ends.y2 AS gy2, CASE WHEN ends.x2 = x AND ends.y2 = y THEN 0.0::DOUBLE ELSE ((px - x) * (ends.x2 - x) + (py - y) * (ends.y2 - y)) / ((ends.x2 - x) * (ends.x2 - x) + (ends.y2 - y) * (ends.y2 - y)) END AS ratio FROM w4 JOIN ends USING (mmsi, pos)), """
    + _inverse("w5", "w6")
    + """, w7 AS (SELECT *, CAST(trunc((m2 - m) * ratio) AS BIGINT) + m AS probe FROM w6),
cells AS (SELECT mmsi, cell_x AS x, cell_y AS y, 16 AS z, 1000000000 * (CASE WHEN metres = 0 THEN probe ELSE probe - CAST(trunc((m2 - m) / metres * a) AS BIGINT) END) AS t_begin_ns,
  1000000000 * (CASE WHEN metres = 0 THEN probe + (m2 - m) ELSE probe + CAST(trunc((m2 - m) / metres * b) AS BIGINT) END) AS t_end_ns FROM w7),
i1 AS (SELECT *, max(t_end_ns) OVER (PARTITION BY mmsi, x, y ORDER BY t_begin_ns, t_end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM cells WHERE t_end_ns >= t_begin_ns),
i2 AS (SELECT *, sum(CASE WHEN t_begin_ns <= so_far THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi, x, y ORDER BY t_begin_ns, t_end_ns ROWS UNBOUNDED PRECEDING) AS island FROM i1)"""
)


@query(_COVERED + " SELECT mmsi, x, y, z, min(t_begin_ns) AS t_begin_ns, max(t_end_ns) AS t_end_ns FROM i2 GROUP BY mmsi, x, y, z, island")
def footprint_cells(spark, sf_dir):
    cells = raster.footprint_cells(_ends(spark, sf_dir), 16, ("mmsi", "pos"))
    return tiles.union_intervals(cells.filter("t_end_ns >= t_begin_ns"), ("mmsi", "x", "y", "z"))


_STOPS = stops.StopConfig(4, 600.0, 86_400.0, 1.5, "haversine")
#: The clustering as a recursion: a row holds a ship's whole state, a stack of points to look at and labels 0 none, 1 noise, 2 edge, 3 core.
_STOP_LABELS = V.replace("WITH e", "WITH RECURSIVE e") + f""", w AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY m, pos) AS i FROM v),
near AS (SELECT p.mmsi, p.i, q.i AS j, q.sog < {_STOPS.speed} AND abs(q.m - p.m) < {_STOPS.seconds} AND {_haversine('p.x', 'p.y', 'q.x', 'q.y')} < {_STOPS.metres} AS ok FROM w p JOIN w q ON p.mmsi = q.mmsi),
reach AS (SELECT mmsi, i, coalesce(max(j) FILTER (NOT ok AND j < i), 0) + 1 AS low, coalesce(min(j) FILTER (NOT ok AND j >= i), max(j) + 1) AS high FROM near GROUP BY mmsi, i),
ship AS (SELECT mmsi, list(low ORDER BY i) AS lows, list(high ORDER BY i) AS highs, list(0 ORDER BY i) AS label, list(-1::BIGINT ORDER BY i) AS cluster FROM reach GROUP BY mmsi),
st AS (
  SELECT mmsi, lows, highs, label, cluster, []::BIGINT[] AS stack, 0::BIGINT AS number, false AS grew, false AS done FROM ship
  UNION ALL
  SELECT mmsi, lows, highs,
    CASE WHEN free AND fresh > 0 THEN list_transform(label, lambda l, k: CASE WHEN k = fresh THEN 1 ELSE l END)
      WHEN core THEN list_transform(label, lambda l, k: CASE WHEN k = i THEN 3 WHEN k >= low AND k < high AND l = 1 THEN 2 WHEN k >= low AND k < high AND l = 0 THEN 1 ELSE l END) ELSE label END,
    CASE WHEN core THEN list_transform(cluster, lambda c, k: CASE WHEN k = i OR (k >= low AND k < high AND label[k] = 1) THEN number ELSE c END) ELSE cluster END,
    CASE WHEN free AND fresh > 0 THEN [fresh] WHEN free THEN [] WHEN core THEN stack[1:len(stack) - 1] || list_filter(list_reverse(range(low, i)), lambda j: label[j] = 0) || list_filter(range(i, high), lambda j: label[j] = 0) ELSE stack[1:len(stack) - 1] END,
    CASE WHEN free AND grew THEN number + 1 ELSE number END, CASE WHEN free THEN false ELSE grew OR core END, free AND fresh = 0
  FROM (SELECT *, NOT free AND high - low >= {_STOPS.min_points} AS core FROM (SELECT *, lows[i] AS low, highs[i] AS high FROM (
    SELECT *, len(stack) = 0 AS free, coalesce(list_position(label, 0), 0)::BIGINT AS fresh, stack[len(stack)] AS i FROM st WHERE NOT done)))),
lab AS (SELECT w.*, ['noise', 'edge', 'core'][label[i]] AS label, CASE WHEN cluster[i] >= 0 THEN cluster[i] END AS cluster_id FROM st JOIN w USING (mmsi) WHERE done)"""


def _labels(spark, sf_dir) -> DataFrame:
    return stops.label_stops(view.points(spark, sf_dir), _STOPS)


@query(_STOP_LABELS + " SELECT event_id, label, cluster_id FROM lab")
def stop_labels(spark, sf_dir):
    return _labels(spark, sf_dir).select("event_id", "label", "cluster_id")


@query(f"""{V}, c AS (SELECT *, CASE WHEN k % 5 < 3 THEN k // 50 END AS cluster_id FROM v), n AS (SELECT *, CASE WHEN pos > 1 AND cluster_id IS NOT DISTINCT FROM lag(cluster_id) OVER o THEN 0 ELSE 1 END AS fresh FROM c WINDOW o AS (PARTITION BY mmsi ORDER BY m, pos)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY mmsi ORDER BY m, pos ROWS UNBOUNDED PRECEDING) - 1 AS part_id FROM n)
SELECT mmsi, CAST(part_id AS BIGINT) AS part_id, CASE WHEN any_value(cluster_id) IS NULL THEN 'move' ELSE 'stop' END AS kind, min(m) AS t_start_s, max(m) AS t_end_s, count(*) AS n_points FROM p GROUP BY mmsi, part_id""")
def stop_move_islands(spark, sf_dir):
    rows = view.points(spark, sf_dir).withColumn("cluster_id", F.when(F.col("k") % 5 < 3, F.expr("k div 50")))
    return stops.stop_parts(rows).drop("coords", "cluster_id")


_STOP_PARTS = _STOP_LABELS + """, n1 AS (SELECT *, CASE WHEN i > 1 AND cluster_id IS NOT DISTINCT FROM lag(cluster_id) OVER (PARTITION BY mmsi ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM lab),
n2 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY mmsi ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS part_id FROM n1),
parts AS (SELECT mmsi, part_id, CASE WHEN any_value(cluster_id) IS NULL THEN 'move' ELSE 'stop' END AS kind, any_value(cluster_id) AS cluster_id, min(m) AS t_start_s, max(m) AS t_end_s, count(*) AS n_points FROM n2 GROUP BY mmsi, part_id)"""
#: Sides of the hulls on whole thousandths of a degree, which the test tables have: all other points lie to the left, or on the side itself.
_STOP_HULLS = _STOP_PARTS + """, pt AS (SELECT DISTINCT mmsi, part_id, CAST(round(x * 1000) AS BIGINT) AS u, CAST(round(y * 1000) AS BIGINT) AS w FROM n2 WHERE cluster_id IS NOT NULL),
side AS (SELECT a.mmsi, a.part_id, a.u AS u1, a.w AS w1, b.u AS u2, b.w AS w2 FROM pt a JOIN pt b ON a.mmsi = b.mmsi AND a.part_id = b.part_id AND (a.u <> b.u OR a.w <> b.w)),
turn AS (SELECT side.*, (u2 - u1) * (c.w - w1) - (w2 - w1) * (c.u - u1) AS side_of, c.u BETWEEN least(u1, u2) AND greatest(u1, u2) AND c.w BETWEEN least(w1, w2) AND greatest(w1, w2) AS on_it FROM side JOIN pt c USING (mmsi, part_id)),
hull AS (SELECT mmsi, part_id, u1 * w2 - u2 * w1 AS twice FROM turn GROUP BY mmsi, part_id, u1, w1, u2, w2 HAVING min(side_of) >= 0 AND bool_and(side_of <> 0 OR on_it)),
areas AS (SELECT mmsi, part_id, round(sum(twice) / 2.0::DOUBLE, 3) AS area FROM hull GROUP BY mmsi, part_id),
boxes AS (SELECT mmsi, part_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM n2 GROUP BY mmsi, part_id)"""


@query(_STOP_PARTS + " SELECT * FROM parts")
def stop_parts(spark, sf_dir):
    return stops.stop_parts(_labels(spark, sf_dir)).drop("coords")


def _area_of(ring: str) -> str:
    """Area of a polygon, in millionths of a square degree."""
    return f"round(abs(aggregate(sequence(0, size({ring}) - 1), 0D, (s, i) -> s + {ring}[i].x * {ring}[(i + 1) % size({ring})].y - {ring}[(i + 1) % size({ring})].x * {ring}[i].y)) * 500000, 3)"


@query(_STOP_HULLS + " SELECT mmsi, part_id, cluster_id, t_start_s, t_end_s, coalesce(area, 0.0::DOUBLE) AS area, min_x, min_y, max_x, max_y FROM parts JOIN boxes USING (mmsi, part_id) LEFT JOIN areas USING (mmsi, part_id) WHERE kind = 'stop'")
def stop_hulls(spark, sf_dir):
    """Hulls by their areas and boxes."""
    hulls = stops.stop_hulls(stops.stop_parts(_labels(spark, sf_dir)))
    ends = {f"{f}_{c}": F.expr(f"array_{f}(transform(hull, p -> p.{c}))") for f in ("min", "max") for c in "xy"}
    return hulls.select("mmsi", "part_id", "cluster_id", "t_start_s", "t_end_s", F.expr(_area_of("hull")).alias("area"), *[v.alias(k) for k, v in ends.items()])


@query(_STOP_HULLS + " SELECT mmsi, part_id, area FROM areas WHERE area > 0")
def stop_triangles(spark, sf_dir):
    """Triangles by what they cover together, which is the hull."""
    rows = stops.stop_triangles(stops.stop_hulls(stops.stop_parts(_labels(spark, sf_dir))))
    one = F.expr("abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) * 500000")
    return rows.groupBy("mmsi", "part_id").agg(F.round(F.sum(one), 3).alias("area")).filter("area > 0")


@query(_LINES + f" SELECT mmsi, pos, round({_haversine('x', 'y', 'x2', 'y2')} / 1.0 * {geo.MS_TO_KNOT}, 3) AS knots, x - x2 AS dx, y - y2 AS dy, x AS from_x, m::DOUBLE AS from_m, y2 AS to_y, x AS flat_x, y AS flat_y FROM l WHERE m2 IS NOT NULL")
def points_and_lines(spark, sf_dir):
    """Vertices and lines as values, the same without their measure, differences of points, and knots."""
    rows = seg.lines(view.points(spark, sf_dir))
    line = geo.line(geo.coord("x", "y", "m"), geo.coord("x2", "y2", "m2"))
    dx, dy = geo.point_difference("x", "y", "x2", "y2")
    rows = rows.withColumns({"line": line, "dx": dx, "dy": dy, "knots": F.round(geo.haversine("x", "y", "x2", "y2") * geo.MS_TO_KNOT, 3)})
    flat = geo.without_measure("line.from")
    return rows.select("mmsi", "pos", "knots", "dx", "dy", F.col("line.from.x").alias("from_x"), F.col("line.from.m").alias("from_m"), F.col("line.to.y").alias("to_y"), flat["x"].alias("flat_x"), flat["y"].alias("flat_y"))


@query(_cut(f"step_s < {SECONDS}") + _SUMMARY)
def csv_export(spark, sf_dir):
    """A report of segments, written as one CSV file and read again."""
    path = shared_path(spark, "report")
    sinks.export_csv(seg.summaries(seg.segment(view.points(spark, sf_dir), _TIME)), path)
    return spark.read.option("header", True).schema("mmsi int, seg_id bigint, n_points bigint, m_first bigint, m_last bigint").csv(path)


@query(_cut(f"step_s < {SECONDS}") + """ SELECT mmsi, min(t) AS t_start_s, CAST(CASE WHEN count(*) = 1 THEN 0 ELSE max(t) - min(t) END AS DOUBLE) AS duration_s FROM s GROUP BY mmsi, seg_id HAVING seg_id % 3 <> 0""")
def sink_antijoin(spark, sf_dir):
    cut = seg.intervals(seg.segment(view.points(spark, sf_dir), _TIME))
    there = sinks.sub_traj_intervals(cut.filter("seg_id % 3 = 0"))
    rows = sinks.sub_traj_intervals(cut)
    found = sinks.fresh(rows.unionByName(rows), there, sinks.INTERVAL_KEY)
    return found.select("mmsi", F.unix_seconds("t_start").alias("t_start_s"), "duration_s")


@query(_cut(f"step_s < {SECONDS}") + ", z AS (SELECT mmsi, seg_id, list({'x': x, 'y': y, 'm': t::DOUBLE} ORDER BY t, pos) AS c FROM s GROUP BY mmsi, seg_id) SELECT mmsi, count(*) AS n_new FROM (SELECT DISTINCT mmsi, c FROM z) GROUP BY mmsi")
def sink_geometries(spark, sf_dir):
    parts = seg.pieces(seg.segment(view.points(spark, sf_dir), _TIME))
    return sinks.fresh(sinks.trajectory_splits(parts, 0, SECONDS), None, sinks.SPLIT_KEY).groupBy("mmsi").agg(F.count("*").alias("n_new"))


@query(f"{V} SELECT event_id, mmsi, m_us // 1000000 AS m, x, y, sog FROM v")
def csv_roundtrip(spark, sf_dir):
    rows = view.points(spark, sf_dir)
    known = {"# Timestamp": F.date_format(F.timestamp_micros("m_us"), ais_csv.TIME), "MMSI": F.col("mmsi"), "Latitude": F.col("y"), "Longitude": F.col("x"), "SOG": F.col("sog"), "IMO": F.col("event_id").cast("string")}
    raw = rows.select(*[known.get(c, F.lit(None)).cast("string").alias(c) for c in schemas.AIS_CSV])
    path = shared_path(spark, "csv")
    raw.write.option("header", True).csv(path)
    back = ais_csv.read(spark, path)
    return back.select(F.col("IMO").cast("bigint").alias("event_id"), F.col("MMSI").cast("int").alias("mmsi"), F.unix_seconds("`# Timestamp`").alias("m"), F.col("Longitude").alias("x"), F.col("Latitude").alias("y"), F.col("SOG").alias("sog"))


@query(_cut(f"step_s < {SECONDS}") + " SELECT mmsi, seg_id, x, y, t::DOUBLE AS m FROM s WHERE (mmsi, seg_id) IN (SELECT (mmsi, seg_id) FROM s GROUP BY mmsi, seg_id HAVING count(*) > 1)")
def wkb_roundtrip(spark, sf_dir):
    parts = seg.pieces(seg.segment(view.points(spark, sf_dir), _TIME)).filter("kind = 'sub'")
    back = parts.select("mmsi", "seg_id", wkb.linestring(wkb.to_wkb("coords")).alias("coords"))
    return back.select("mmsi", "seg_id", F.explode("coords").alias("v")).select("mmsi", "seg_id", "v.x", "v.y", "v.m")


@query(_cut(f"step_s <= {SECONDS}", "(m_us / 1000000.0::DOUBLE)") + " SELECT mmsi, count(*) AS n_points, CAST(round(min(t) * 1000000) AS BIGINT) AS first_us, CAST(round(max(t) * 1000000) AS BIGINT) AS last_us FROM s GROUP BY mmsi, seg_id")
def session_windows(spark, sf_dir):
    from wakeline.streaming.sessions import time_sessions

    rows = view.points(spark, sf_dir).select("mmsi", F.timestamp_micros("m_us").alias("timestamp"))
    out = time_sessions(rows, SECONDS)
    return out.select("mmsi", "n_points", F.unix_micros("t_first").alias("first_us"), F.unix_micros("t_last").alias("last_us"))
