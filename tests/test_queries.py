"""Every query runs, and equals its SQL text where it has one."""

import math

import duckdb
import pytest

from pointweave.queries import QUERIES

from .conftest import TABLES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return f"{value:.5f}" if isinstance(value, float) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, db):
    query = QUERIES[name]
    found = query.run(spark, sf)
    got = rows(found.columns, found.collect())
    if query.sql is None:
        assert got
        return
    relation = db.sql(query.sql)
    assert sorted(found.columns) == sorted(relation.columns)
    assert got == rows(relation.columns, relation.fetchall())
