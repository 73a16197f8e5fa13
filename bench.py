"""Headline queries, timed.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tarn.plans.queries import CASES, CSV_JOIN, FLAGSHIP, _CUSTOMER, _ORDERS, csv_tables, run

QUERIES = {
    "join_group_sum": FLAGSHIP,
    "three_way_join": CASES["JN-8_multi"][0],
    "point_filter": CASES["SRC-11_index_scan"][0],
    "range_half": "SELECT COUNT(*) AS n, SUM(l_quantity) AS s FROM lineitem WHERE l_quantity > 25",
    "range_percent": "SELECT COUNT(*) AS n, SUM(l_extendedprice) AS s FROM lineitem WHERE l_quantity > 49.5",
    "wide_group": "SELECT l_orderkey, SUM(l_quantity) AS s FROM lineitem GROUP BY l_orderkey",
    "count_distinct": CASES["AGG-10_distinct"][0],
    "top_k": CASES["LIM-1_top"][0],
    "combined": CASES["combined"][0],
}


def timed(make) -> float:
    """Median of five runs after a first one; parsing and planning count."""
    seconds = []
    for _ in range(6):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
    return round(statistics.median(seconds[1:]), 4)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out, seconds = {}, []
    for _ in range(3):
        session = csv_tables(spark, sf_dir, {"orders": _ORDERS, "customer": _CUSTOMER})
        began = time.perf_counter()
        for name in ("orders", "customer"):
            session.load_csv(session.csv[name], name)
        seconds.append(time.perf_counter() - began)
    out["csv_load"] = round(statistics.median(seconds[1:]), 4)
    out["csv_join_group_sum"] = timed(lambda: session.sql(CSV_JOIN))
    for name, statement in QUERIES.items():
        out[name] = timed(lambda: run(spark, sf_dir, statement))  # noqa: B023
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
