"""Every registered query against its SQL in DuckDB over the same tables."""

import os

import duckdb
import pytest

from cairnflow.catalog import FLAGSHIP, ORACLES, QUERIES


def plain(value):
    return round(value, 9) if isinstance(value, float) else value if isinstance(value, (bool, type(None))) else str(value)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{data}/{name}'")
    return con


def test_enough_queries_have_sql():
    assert FLAGSHIP in ORACLES
    assert len(ORACLES) >= 200
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    frame = QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in ORACLES:
        return
    said = duck.sql(ORACLES[name])
    assert sorted(said.columns) == columns
    at = [said.columns.index(c) for c in columns]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in said.fetchall())
