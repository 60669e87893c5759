"""Every registered query of the library against DuckDB on the driver's smallest tables."""

import os

import duckdb
import pytest

from tidejoin import oracles
from tidejoin import queries as core

QUERIES = core.queries()
#: These take long; each is also tested in test_streaming, test_keyed or test_liveness.
SLOW = {"stream_join_deltas", "stream_keyed_join", "stream_revenue", "stream_updates", "liveness_deltas"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        name = t.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{t}'")
    return con


def rows(values):
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(norm, r)) for r in values), key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(oracles.oracle_sql()[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(tuple(r[i] for i in place) for r in want.fetchall())


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(oracles.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 20
