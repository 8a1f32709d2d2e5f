"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from linkrisk.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "part", "lineitem", "nation", "region")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.8g}")
    return value.isoformat()[:10] if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in queries.ORACLES:
        want = tables.sql(queries.ORACLES[name])
        columns = list(want.columns)
        assert sorted(columns) == sorted(df.columns)
        order = [columns.index(c) for c in df.columns]
        assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_registry_is_complete(spark):
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0
