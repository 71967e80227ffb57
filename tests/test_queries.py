"""Every driver query against its SQL."""

import duckdb
import pytest

from wakeline.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert len(set(columns)) == len(columns)
    if name in SQL:
        got = con.execute(SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert rows == sorted((tuple(r[names.index(c)] for c in columns) for r in got.fetchall()), key=str)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 585
    assert set(entry.oracle_sql()) <= set(entry.queries())
