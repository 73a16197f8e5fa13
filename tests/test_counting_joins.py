"""Statements that only count the rows of a join: their work must not grow with the product of equal keys."""

import threading

import pytest
from pyspark.sql import functions as F

from tarn.functions import exprs as E
from tarn.session import Session


def test_count_of_equal_keys_is_not_made_row_by_row(spark):
    session, n = Session(spark), 1 << 20
    session.register("a", spark.range(n).selectExpr("CAST(id % 3 AS int) AS k"))
    session.register("b", spark.range(n).selectExpr("CAST(id % 4 AS double) AS x"))
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        (row,) = session.sql("SELECT COUNT(*) AS n FROM a JOIN b ON a.k = b.x").collect()
    finally:
        stop.cancel()
    assert row.n == n * (n >> 2)


@pytest.fixture(scope="module")
def session(spark):
    session, nan = Session(spark), float("nan")
    left = [(1, 1.0, "p"), (1, 1.0, "p"), (1, None, "q"), (2, 0.0, "q"), (2, -0.0, "q"), (None, 3.0, None), (3, nan, "r"), (9, 2.0, "p")]
    right = [(1.0, 5, 1), (1.0, 5, 2), (1.0, None, 2), (2.0, 6, 1), (nan, 6, 3), (None, 6, 3), (0.0, 7, 2), (-0.0, 7, 2), (3.0, 2, 1)]
    session.register("a", spark.createDataFrame(left, "k int, x double, s string"))
    session.register("b", spark.createDataFrame(right, "y double, v long, w int"))
    session.register("none", spark.createDataFrame([], "y double"))
    return session


@pytest.mark.parametrize("overflow", ["error", "float"])
@pytest.mark.parametrize(
    "sql",
    [
        "SELECT COUNT(*) AS n FROM a JOIN b ON a.k = b.y",
        "SELECT COUNT(*) AS n FROM a JOIN b ON a.x = b.y",
        "SELECT COUNT(*) AS n, COUNT(v) AS c, COUNT(DISTINCT v) AS d, COUNT(x + v) AS e, COUNT(NULL) AS f FROM a JOIN b ON k = y",
        "SELECT COUNT(*) AS n FROM a JOIN b ON k = y AND w = k",
        "SELECT COUNT(*) AS n FROM a JOIN b ON k = y AND w > k",
        "SELECT COUNT(*) AS n FROM a JOIN b ON x = y WHERE y < 2 AND x >= 0 AND v <> w",
        "SELECT COUNT(*) AS n FROM a JOIN b ON x = y WHERE LENGTH(x) = 2 AND s LIKE 'Q'",
        "SELECT s, COUNT(*) AS n, COUNT(v) * 2 AS c FROM a JOIN b ON k = y GROUP BY s HAVING COUNT(*) > 1 ORDER BY n DESC, s",
        "SELECT s, w FROM a JOIN b ON k = y GROUP BY s, w",
        "SELECT v, s, COUNT(*) AS n FROM a JOIN b ON k = y GROUP BY s",
        "SELECT COUNT(*) AS n, SUM(v) AS t, MIN(x) AS lo FROM a JOIN b ON k = y",
        "SELECT COUNT(*) AS n FROM a LEFT JOIN b ON k = y",
        "SELECT COUNT(*) AS n, COUNT(k) AS c FROM a JOIN none ON x = y",
        "SELECT s, COUNT(*) AS n FROM a JOIN none ON x = y GROUP BY s",
        "SELECT COUNT(*) AS n FROM a JOIN b ON s = v",
        "SELECT COUNT(*) AS n FROM a p JOIN a q ON p.k = q.x",
        "SELECT COUNT(*) AS n FROM a p JOIN a q ON p.k = q.k AND p.s = q.s",
    ],
)
def test_counts_are_those_of_the_rows(session, sql, overflow):
    got = session.sql(sql, overflow)
    session.set_join_mode("nested")  # joins row by row
    try:
        rows = session.sql(sql, overflow)
        assert got.schema.simpleString() == rows.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    finally:
        session.set_join_mode("auto")


def test_counts_by_hand(session):
    one = lambda sql: [tuple(r) for r in session.sql(sql).collect()]
    assert one("SELECT COUNT(*), COUNT(v) FROM a JOIN b ON k = y") == [(12, 9)]
    assert one("SELECT COUNT(*) FROM a JOIN b ON x = y") == [(12,)]
    assert one("SELECT COUNT(*) FROM a JOIN none ON x = y") == [(0,)]


def test_a_count_that_leaves_64_bits_is_an_error(spark):
    frame = spark.range(2).select(F.lit(1 << 40).alias("a"), F.lit(1 << 22).alias("b"))
    with pytest.raises(Exception, match="leaves 64 bits"):
        frame.select(E.product(F.col("a"), F.col("a"))).collect()
    with pytest.raises(Exception, match="leaves 64 bits"):
        frame.agg(E.rows(E.product(F.col("a"), F.col("b"))).col).collect()
