import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallybrook.plans import oracle, queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, [tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in r) for r in frame.itertuples(index=False, name=None)]))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, expected = queries.queries()[name](spark, D).toPandas(), duck.execute(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
