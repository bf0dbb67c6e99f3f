"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from ripplemark.plans.views import TABLES

DATA = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def connection():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df, columns):
    return sorted(tuple(round(float(x), 9) if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, connection, name):
    got, expected = entry.queries()[name](spark, DATA).toPandas(), connection.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)
