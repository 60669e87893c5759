"""The operators that SQL can express, against DuckDB on the driver's smallest tables."""

import duckdb
import pytest

from tidejoin.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)
