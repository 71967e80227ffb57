import pytest
from pyspark.sql import functions as F

from wakeline import schemas
from wakeline.sources import ais_csv, sinks, tables


def test_csv(spark, tmp_path):
    header = ",".join(schemas.AIS_CSV)
    rows = [
        "01/02/2024 00:00:01,Base Station,2190064,56.5,11.9,Unknown value,,,,,Unknown,Unknown,,Undefined,,,,GPS,,Unknown,,AIS,,,,",
        "01/02/2024 00:00:02,Class A,219024000,57.1,10.2,Engaged in fishing,0.0,1.5,30.2,31,Unknown,XPA,BOAT,Fishing,,5,15,GPS,2.4,HOME,03/02/2024 10:00:00,AIS,10,5,3,2",
    ]
    path = tmp_path / "ais.csv"
    path.write_text("\n".join([header, *rows]) + "\n")
    got = ais_csv.read(spark, str(path)).collect()
    assert got[1]["MMSI"] == 219024000 and got[1]["Width"] == 5 and got[0]["SOG"] is None and str(got[1]["# Timestamp"]) == "2024-02-01 00:00:02"
    assert [r.mmsi for r in ais_csv.positions(ais_csv.read(spark, str(path))).collect()] == [219024000]
    path.write_text("\n".join([header, rows[0].replace("56.5", "north")]) + "\n")
    with pytest.raises(Exception):
        ais_csv.read(spark, str(path)).collect()
    assert ais_csv.read(spark, str(path), strict=False).first()["Latitude"] is None


def test_sink_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, 5), (1, 20, 0), (1, 10, 7), (2, 10, 1)], "mmsi int, t_start_s long, duration_s long")
    path = str(tmp_path / "out")
    sinks.append(sinks.sub_traj_intervals(rows), path, sinks.INTERVAL_KEY)
    first = sorted(map(tuple, spark.read.parquet(path).select("mmsi", F.unix_seconds("t_start"), "duration_s").collect()))
    assert first == [(1, 10, 5.0), (1, 20, 0.0), (2, 10, 1.0)]
    sinks.append(sinks.sub_traj_intervals(rows), path, sinks.INTERVAL_KEY)
    assert spark.read.parquet(path).count() == 3
    sinks.append(sinks.sub_traj_intervals(rows.withColumn("mmsi", F.lit(9))), path, sinks.INTERVAL_KEY)
    assert spark.read.parquet(path).count() == 5


def test_export(spark, tmp_path):
    sinks.export_csv(spark.range(3), str(tmp_path / "x"))
    (file,) = (tmp_path / "x").glob("part-*")
    assert file.read_text().split() == ["id", "0", "1", "2"]


def test_embedded_database(spark):
    """Reads by several connections, pushed-down windows, and a sink written twice, in an embedded database."""
    db = tables.Database("", 0, "APP", "app", "", "APP", "org.apache.derby.iapi.jdbc.AutoloadedDriver", "jdbc:derby:memory:ships;create=true")
    made = lambda ids: spark.createDataFrame([(i, float(i % 7), 10 * i) for i in ids], "mmsi int, sog double, t long").select("mmsi", "sog", F.timestamp_seconds("t").alias("timestamp"))
    rows = made(range(100))
    rows.write.format("jdbc").options(**db.options("SOG")).mode("overwrite").save()
    got = db.read(spark, "SOG", 4, (0, 100))
    assert got.rdd.getNumPartitions() == 4
    assert sorted(got.collect()) == sorted(rows.collect())
    window = tables.at_times(db.read(spark, "SOG"), 100, 200)
    assert window.count() == 11 and "PushedFilters: [*" in window._jdf.queryExecution().toString()
    for more, want in ((rows.limit(0), 100), (rows, 100), (made(range(50, 150)), 150), (made(range(50, 150)), 150)):
        sinks.append_jdbc(more, db.options("SOG"), ("mmsi", "timestamp"))
        assert db.read(spark, "SOG").count() == want


def test_database():
    env = {"DB_HOSTNAME": "h", "DB_PORT": "5432", "DB_USERNAME": "u", "DB_PASSWORD": "p", "DB_NAME": "n"}
    db = tables.Database.from_env(env)
    assert db.options("sog")["url"] == "jdbc:postgresql://h:5432/n" and db.options("sog")["dbtable"] == "program_data.sog"
    with pytest.raises(KeyError, match="DB_NAME"):
        tables.Database.from_env({k: v for k, v in env.items() if k != "DB_NAME"})


def test_pages(spark):
    ships = spark.createDataFrame([(i * 1000,) for i in range(95)] + [(0,)], "mmsi int")
    got = {r.mmsi: r.page for r in tables.ship_pages(ships, 10).collect()}
    assert got == {i * 1000: i // 10 for i in range(95)}
    assert tables.page(ships.distinct(), 9, 10).count() == 5 and tables.page(ships, 12, 10).count() == 0


def test_pushdown(spark, tmp_path):
    df = spark.createDataFrame([(1, i, 0.0, 0.0, float(i)) for i in range(10)], "mmsi int, pos long, x double, y double, m double")
    df.write.parquet(str(tmp_path / "trajectories.parquet"))
    from wakeline.operators.segmentation import clip

    got = clip(tables.read_parquet(spark, str(tmp_path), "trajectories"), 3.9, 5).select("pos")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(m,3.0)" in plan and "ReadSchema: struct<pos:bigint,m:double>" in plan
    assert sorted(r.pos for r in got.collect()) == [3, 4, 5]


def test_window(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0), (1, 1, 0.0, 0.0, 15.0), (2, 0, 0.0, 0.0, 50.0)], "mmsi int, pos long, x double, y double, m double")
    dims = spark.createDataFrame([(1, 2.0, 9.0), (2, 3.0, 8.0)], "mmsi int, width double, length double")
    spans = spark.createDataFrame([(1, 0, 4), (1, 4, 10), (1, 11, 60)], "mmsi int, b long, e long").select("mmsi", F.timestamp_seconds("b").alias("time_begin"), F.timestamp_seconds("e").alias("time_end"))
    ships = tables.Ships({"trajectories": points, "dimensions": dims, "draught": spans}).window(5.5, 10.5)
    assert ships.trajectories.count() == 1 and ships.dimensions.count() == 1 and ships.draught.count() == 1
    with pytest.raises(AttributeError):
        ships.nothing
