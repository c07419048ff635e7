"""Every registered query that has SQL gives the SQL's rows."""

import glob
import os

import duckdb
import pytest

from factloom.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set temp_directory = ''")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_match(spark, duck, name):
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(duck.sql(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
