"""Every registered query of the reference's own operators against DuckDB on the smallest tables."""

import collections
import glob
import os

import duckdb
import pytest

from tessera.jobs import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
KIND = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KIND[k] for c, k in got.dtypes} == kinds
    at = [want.columns.index(c) for c in columns]
    assert collections.Counter(map(tuple, got.select(columns).collect())) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())
