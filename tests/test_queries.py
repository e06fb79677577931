"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import TABLES, close, rows_of

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["label", "conformity", "n"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    a, b = rows_of(df.columns, got), rows_of(columns, cursor.fetchall())
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b) for x, y in zip(r, s))
