"""Sums of time over ships that pass BIGINT, where the SQL has no result: two ships in one cell for 150 years each."""

from decimal import Decimal

import pytest

from wakeline.operators import tiles
from wakeline.plans import queries

SECONDS = 150 * 365 * 86_400


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    rows = [(ship * 2 + i, i * SECONDS, ship, k) for ship in (0, 1) for i, k in enumerate((49, 50))]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, k long")
    events.selectExpr("event_id", "cast(timestamp_seconds(s) as timestamp_ntz) AS ts", "user_id", "'view' AS event_type", "50.0D AS value", "concat('{\"k\": ', k, '}') AS props").write.parquet(f"{path}/events.parquet")
    spark.range(2).withColumnRenamed("id", "c_custkey").write.parquet(f"{path}/customer.parquet")
    return path


@pytest.mark.parametrize("name, zooms", [("tile_pyramid", 3), ("tile_rezoom", 1), ("tile_heatmap", 1)])
def test_query(spark, long_dir, name, zooms):
    got = queries.QUERIES[name](spark, long_dir).collect()
    assert [(r.cell_oc_ns, r.distinct_ship_count) for r in got] == [(2 * SECONDS * 10**9, 2)] * zooms


def test_narrow(spark):
    fits = spark.createDataFrame([(1, Decimal(2**63 - 1)), (2, None), (3, Decimal(-(2**63)))], "x int, cell_oc_ns decimal(38,0)")
    got = tiles.narrow(fits)
    assert got.dtypes == [("x", "int"), ("cell_oc_ns", "bigint")] and sorted(got.collect()) == sorted(fits.collect())
    over = spark.createDataFrame([(1, Decimal(2**63)), (2, None)], "x int, cell_oc_ns decimal(38,0)")
    got = tiles.narrow(over)
    assert got.dtypes == over.dtypes and sorted(got.collect()) == sorted(over.collect())
