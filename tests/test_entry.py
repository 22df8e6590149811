"""The driver contract, and every query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, expected = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


def test_flagship(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
