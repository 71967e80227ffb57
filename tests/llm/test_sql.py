"""Queries that SQL can express, side by side."""

import duckdb
import pytest

from wakeline.llm.registry import oracle_sql, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = con.execute(oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in got.fetchall())
    assert want and sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_all_are_registered():
    assert [n.split("_")[0] for n in sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 11)]
