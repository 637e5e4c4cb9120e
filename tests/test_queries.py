"""Every query with SQL gives DuckDB's rows; the others run and keep a schema."""

import math

import duckdb
import pytest

from tidemark.plans import ORACLE_SQL, QUERIES
from tidemark.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in found.select(*columns).collect())
    if name in ORACLE_SQL:
        wanted = tables.sql(ORACLE_SQL[name])
        assert sorted(wanted.columns) == columns
        order = [wanted.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in order) for r in wanted.fetchall())
