"""Every query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quire.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    same = lambda x: x[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(same(got), same(want), check_dtype=False)
    assert len(got)
