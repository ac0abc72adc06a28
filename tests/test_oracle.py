"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in os.listdir(FOLDER)] if os.path.isdir(FOLDER) else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def _normal(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted(str(tuple(value(r[i]) for i in order)) for r in data)


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_query(spark, duck, name):
    df = catalog.all_queries()[name](spark, FOLDER)
    result = duck.execute(catalog.all_oracles()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = _normal(df.columns, df.collect()), _normal(columns, result.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert got
