"""Every registered statement against DuckDB on the smallest tables."""

import numbers
import os

import pytest

from tarn.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def canonical(frame):
    import pandas as pd

    one = lambda v: "NULL" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, numbers.Number) else str(v)
    return sorted(tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)
