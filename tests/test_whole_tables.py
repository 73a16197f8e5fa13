"""Registered statements against counts made from whole tables, without SQL."""

import os
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tarn.plans.queries import QUERIES
from tarn.session import Session

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def column(table, name):
    return pq.read_table(f"{SF}/{table}.parquet", columns=[name])[name].to_pylist()


def test_int_float_join_takes_all_parts(spark):
    sizes, quantities = Counter(column("part", "p_size")), Counter(column("lineitem", "l_quantity"))
    (row,) = QUERIES["JN-5_int_float"](spark, SF).collect()
    assert row.n == sum(n * quantities[size] for size, n in sizes.items() if size is not None)


def test_index_join_takes_all_customers(spark, monkeypatch):
    made, index = [], Session.index
    monkeypatch.setattr(Session, "index", lambda self, *how: made.append(how) or index(self, *how))
    names = dict(zip(column("customer", "c_custkey"), column("customer", "c_name"), strict=True))
    orders = zip(column("orders", "o_custkey"), column("orders", "o_totalprice"), strict=True)
    got = QUERIES["JN-6_index"](spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter((names[c], price) for c, price in orders if c in names)
    assert made == [("orders", "o_custkey", "hash")]


def test_sorts_return_all_rows(spark):
    toxic = dict(zip(column("labels", "doc_id"), column("labels", "toxic"), strict=True))
    placed = sorted(((i, toxic.get(i)) for i in column("documents", "doc_id")), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [tuple(r) for r in QUERIES["ORD-5_nulls"](spark, SF).collect()] == placed and {t for _, t in placed} == {None, 0, 1}
    assert [r.k for r in QUERIES["ORD-3_alias"](spark, SF).collect()] == sorted(column("part", "p_partkey"))
    segments = sorted(Counter(column("customer", "c_mktsegment")).items(), key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in QUERIES["ORD-2_position"](spark, SF).collect()] == segments and len(segments) > 3


def test_index_is_noted_and_leaves_the_plan(spark):
    session = Session(spark)
    session.load_parquet(f"{SF}/orders.parquet", "orders")
    frame = session.table("orders").frame
    session.index("orders", "o_custkey", "SORTED")
    assert session.indexes == [("orders", "o_custkey", "sorted")]
    assert session.table("orders").frame is frame and not frame.is_cached
    assert "keeps the table in memory" not in Session.index.__doc__
