"""The dialect's operators on the driver's tables: statement, and the same as DuckDB SQL.

Each entry of ``CASES`` is id -> (statement, oracle SQL).  The statements go through the session, so they
exercise parser, binder and lowering.  Predicates that a statement projects are INT 1/0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..session import Session
from ..shared import scratch
from ..sql.parser import parse
from ..sql.tree import Select

FLAGSHIP = "SELECT n.n_name, COUNT(*) AS cnt, SUM(o.o_totalprice) AS total FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY n.n_name ORDER BY n_name"


def run(spark: SparkSession, sf_dir: str, statement: str, mode: str = "auto", index: tuple[str, ...] = (), overflow: str = "error") -> DataFrame:
    session = Session(spark)
    tree: Select = parse(statement)
    for name in {tree.table.name, *(j.table.name for j in tree.joins)}:
        session.load_parquet(f"{sf_dir}/{name}.parquet", name)
    session.set_join_mode(mode)
    if index:
        session.index(*index)
    return session.sql(statement, overflow)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, FLAGSHIP)


def _as_is(statement: str) -> tuple[str, str]:
    return statement, statement


CASES: dict[str, tuple[str, str]] = {
    # scans and projections
    "SRC-10_scan": _as_is("SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "PRJ-1_project": _as_is("SELECT l_orderkey AS k, l_quantity * l_extendedprice AS v FROM lineitem"),
    "PRJ-2_star": _as_is("SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "PRJ-3_names": ("SELECT n_name, UPPER(n_name), n_nationkey + 1 FROM nation", 'SELECT n_name, upper(n_name) AS "UPPER", n_nationkey + 1 AS expr FROM nation'),
    "PRJ-4_qualified": _as_is("SELECT n.n_name, n.n_nationkey FROM nation n ORDER BY n.n_nationkey"),
    "SRC-11_index_scan": _as_is("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 370"),
    # filters and comparisons
    "FIL-1_where": ("SELECT p_partkey FROM part WHERE p_size", "SELECT p_partkey FROM part WHERE p_size <> 0"),
    "CMP-1_eq": _as_is("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'"),
    "CMP-2_ne": _as_is("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity != 10"),
    "CMP-3_lt": _as_is("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10"),
    "CMP-4_gt": _as_is("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45"),
    "CMP-5_le": _as_is("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.02"),
    "CMP-6_ge": _as_is("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax >= 0.07"),
    "CMP-7_kinds": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 1", "SELECT CAST(0 AS BIGINT) AS n"),
    "CMP-9_date_join": _as_is("SELECT o.o_orderkey, COUNT(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND o.o_orderdate < l.l_shipdate WHERE o.o_orderdate >= '1995-06-01' AND l.l_shipdate BETWEEN '1995-06-01' AND '1998-01-01' GROUP BY o.o_orderkey"),
    "CMP-8_projected": ("SELECT o_orderkey, o_totalprice > 100000 AS big, (o_orderstatus = 'F') + 1 AS f FROM orders", "SELECT o_orderkey, CAST(o_totalprice > 100000 AS BIGINT) AS big, CAST(o_orderstatus = 'F' AS BIGINT) + 1 AS f FROM orders"),
    "LOG-1_and": _as_is("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000"),
    "LOG-2_or": _as_is("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 300000"),
    "LOG-3_not": _as_is("SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 50000"),
    "LOG-4_three_valued": _as_is("SELECT COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.toxic = 1 OR l.quality = 1)"),
    "LOG-5_string": ("SELECT COUNT(*) AS n FROM nation WHERE NOT n_name", "SELECT count(*) AS n FROM nation"),
    "PAR-1_precedence": _as_is("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND NOT o_totalprice < 150000 + 2 * 50000"),
    "NUL-1_is_null": _as_is("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL"),
    "NUL-2_is_not_null": _as_is("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL"),
    "IN-1_in": _as_is("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "IN-2_not_in": _as_is("SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3)"),
    "IN-3_null": _as_is("SELECT COUNT(*) AS n FROM part WHERE p_size NOT IN (1, NULL)"),
    "IN-4_empty": ("SELECT COUNT(*) AS n FROM part WHERE NOT p_size IN ()", "SELECT count(*) AS n FROM part"),
    "IN-5_kinds": ("SELECT COUNT(*) AS n FROM part WHERE p_brand NOT IN (1, 2)", "SELECT count(*) AS n FROM part"),
    "BTW-1_between": _as_is("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20"),
    "BTW-2_not_between": _as_is("SELECT p_partkey FROM part WHERE p_retailprice NOT BETWEEN 1000 AND 1500"),
    "BTW-3_null": ("SELECT COUNT(*) AS n FROM part WHERE p_size NOT BETWEEN 60 AND NULL", "SELECT CAST(0 AS BIGINT) AS n"),
    "LIK-1_prefix": ("SELECT p_partkey FROM part WHERE p_type LIKE 'p%'", "SELECT p_partkey FROM part WHERE p_type ILIKE 'p%'"),
    "LIK-2_infix": ("SELECT c_custkey FROM customer WHERE c_mktsegment LIKE '%uil%'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%uil%'"),
    "LIK-3_suffix": ("SELECT c_custkey FROM customer WHERE c_name LIKE '%7'", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%7'"),
    "LIK-4_underscore": ("SELECT p_partkey FROM part WHERE p_brand LIKE 'brand#_3'", "SELECT p_partkey FROM part WHERE p_brand ILIKE 'brand#_3'"),
    "LIK-5_not": ("SELECT COUNT(*) AS n FROM documents WHERE text NOT LIKE '%THE%'", "SELECT count(*) AS n FROM documents WHERE text NOT ILIKE '%THE%'"),
    # joins
    "JN-1_inner": _as_is("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"),
    "JN-2_left": _as_is("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "JN-3_theta": _as_is("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey"),
    "JN-4_hash": _as_is("SELECT COUNT(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey"),
    "JN-5_int_float": _as_is("SELECT COUNT(*) AS n FROM part p JOIN lineitem l ON p.p_size = l.l_quantity"),
    "JN-6_index": _as_is("SELECT c.c_name, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"),
    "JN-7_self": _as_is("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "JN-8_multi": ("SELECT r.r_name, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",) * 2,
    "JN-9_compound": _as_is("SELECT COUNT(*) AS n FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND l.l_quantity > p.p_size"),
    "JN-10_left_compound": _as_is("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000"),
    # aggregation
    "AGG-1_group": _as_is("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "AGG-1b_null_group": _as_is("SELECT l.toxic, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.toxic"),
    "AGG-2_global_empty": ("SELECT COUNT(*) AS n, SUM(p_size) AS s, MIN(p_name) AS m FROM part WHERE p_size < 0", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, min(p_name) AS m FROM part WHERE p_size < 0"),
    "AGG-3_group_only": _as_is("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment"),
    "AGG-4_count_star": _as_is("SELECT COUNT(*) AS n FROM lineitem"),
    "AGG-5_count": _as_is("SELECT COUNT(l.toxic) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "AGG-6_sum": ("SELECT p_brand, SUM(p_size) AS s FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand"),
    "AGG-7_avg": ("SELECT p_brand, ROUND(AVG(p_size), 6) AS a FROM part GROUP BY p_brand", "SELECT p_brand, round(avg(p_size), 6) + 0.0 AS a FROM part GROUP BY p_brand"),
    "AGG-8_min": _as_is("SELECT MIN(o_totalprice) AS a, MIN(o_orderpriority) AS b FROM orders"),
    "AGG-9_max": _as_is("SELECT o_orderstatus, MAX(o_totalprice) AS a, MAX(o_orderpriority) AS b FROM orders GROUP BY o_orderstatus"),
    "AGG-10_distinct": ("SELECT COUNT(DISTINCT l_suppkey) AS a, SUM(DISTINCT l_linenumber) AS b, AVG(DISTINCT l_linenumber) AS c, MIN(DISTINCT l_linenumber) AS d FROM lineitem", "SELECT count(DISTINCT l_suppkey) AS a, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS b, avg(DISTINCT l_linenumber) AS c, CAST(min(DISTINCT l_linenumber) AS BIGINT) AS d FROM lineitem"),
    "AGG-11_expressions": ("SELECT SUM(p_size + 1) AS a, SUM(p_size) / COUNT(*) AS b, ROUND(AVG(p_size), 2) AS c FROM part", "SELECT CAST(sum(p_size + 1) AS BIGINT) AS a, CAST(sum(p_size) // count(*) AS BIGINT) AS b, round(avg(p_size), 2) AS c FROM part"),
    "AGG-12_having": _as_is("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15"),
    "AGG-16_events": _as_is("SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS u FROM events GROUP BY event_type"),
    # distinct, sort, limit
    "DST-1_distinct": _as_is("SELECT DISTINCT p_brand, p_size FROM part"),
    "DST-2_distinct_null": _as_is("SELECT DISTINCT l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "ORD-1_order": _as_is("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey"),
    "ORD-2_position": _as_is("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY 2 DESC, 1"),
    "ORD-3_alias": _as_is("SELECT p_partkey AS k FROM part ORDER BY k"),
    "ORD-5_nulls": ("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY toxic, doc_id", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY toxic NULLS FIRST, d.doc_id"),
    "LIM-1_top": _as_is("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    # arithmetic
    "ART-1_add": _as_is("SELECT o_orderkey, o_orderkey + o_custkey AS a, o_totalprice + 1 AS b FROM orders"),
    "ART-2_subtract": _as_is("SELECT o_orderkey, o_orderkey - o_custkey AS a, o_totalprice - 0.5 AS b FROM orders"),
    "ART-3_multiply": _as_is("SELECT l_orderkey, l_linenumber, l_partkey * l_suppkey AS a, l_quantity * 2 AS b FROM lineitem"),
    "ART-4_divide": ("SELECT o_orderkey, (o_orderkey - 20000) / 7 AS a, o_totalprice / 4 AS b, o_custkey / (o_custkey - o_custkey) AS c, o_totalprice / (o_custkey - o_custkey) AS d FROM orders", "SELECT o_orderkey, (o_orderkey - 20000) // 7 AS a, o_totalprice / 4 AS b, CAST(NULL AS BIGINT) AS c, CAST(NULL AS DOUBLE) AS d FROM orders"),
    "ART-5_negate": _as_is("SELECT o_orderkey, -o_custkey AS a, -o_totalprice AS b FROM orders"),
    "ART-6_overflow": ("SELECT n_nationkey, 9223372036854775807 + n_nationkey + 1 AS a FROM nation", "SELECT n_nationkey, CAST(9223372036854775807 AS DOUBLE) + n_nationkey + 1 AS a FROM nation"),
    "ART-7_null": ("SELECT n_nationkey, n_nationkey + NULL AS a FROM nation", "SELECT n_nationkey, CAST(NULL AS BIGINT) AS a FROM nation"),
    # functions
    "FN-1_upper": ("SELECT doc_id, UPPER(text) AS u FROM documents", "SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u FROM documents"),
    "FN-2_lower": ("SELECT doc_id, LOWER(text) AS u FROM documents", "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM documents"),
    "FN-3_length": ("SELECT doc_id, LENGTH(text) AS n, LENGTH(n_chars) AS m FROM documents", "SELECT doc_id, strlen(text) AS n, strlen(CAST(n_chars AS VARCHAR)) AS m FROM documents"),
    "FN-4_abs": _as_is("SELECT c_custkey, ABS(c_acctbal) AS a, ABS(c_custkey - 700) AS b FROM customer"),
    "FN-5_round": ("SELECT p_partkey, ROUND(p_size) AS a, ROUND(p_size * 0.25) AS b FROM part", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, round(p_size * CAST(0.25 AS DOUBLE)) AS b FROM part"),
    "FN-5_digits": ("SELECT o_orderkey, ROUND(o_totalprice / 7 + 0.000012345, 1) AS a, ROUND(o_totalprice / 7 + 0.000012345, 3) AS b FROM orders", "SELECT o_orderkey, round(o_totalprice / 7 + CAST(0.000012345 AS DOUBLE), 1) AS a, round(o_totalprice / 7 + CAST(0.000012345 AS DOUBLE), 3) AS b FROM orders"),
    "FN-6_coalesce": ("SELECT d.doc_id, COALESCE(l.toxic, -1) AS a, COALESCE(NULL, l.quality, 0.5) AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, COALESCE(l.toxic, -1) AS a, COALESCE(CAST(l.quality AS DOUBLE), 0.5) AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "FN-7_trim": ("SELECT n_nationkey, TRIM('  x y ') AS a, TRIM(n_name) AS b FROM nation", "SELECT n_nationkey, 'x y' AS a, trim(n_name) AS b FROM nation"),
    "FN-8_nested": ("SELECT c_custkey, LENGTH(UPPER(TRIM(c_name))) AS a, ABS(ROUND(c_acctbal)) AS b FROM customer", "SELECT c_custkey, strlen(upper(trim(c_name))) AS a, abs(round(c_acctbal)) AS b FROM customer"),
    "LIT-1_literals": ("SELECT n_nationkey, 123 AS a, 12.5 AS b, 'it''s' AS c, NULL AS d FROM nation", "SELECT n_nationkey, 123 AS a, CAST(12.5 AS DOUBLE) AS b, 'it''s' AS c, CAST(NULL AS VARCHAR) AS d FROM nation"),
    # all together
    "combined": ("SELECT n.n_name, COUNT(*) AS n_items, SUM(l.l_linenumber) AS s FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE l.l_quantity BETWEEN 5 AND 40 AND o.o_orderstatus IN ('F', 'O') AND c.c_mktsegment LIKE '%i%' GROUP BY n.n_name HAVING COUNT(*) > 10 ORDER BY n_items DESC, n_name LIMIT 10", "SELECT n.n_name, count(*) AS n_items, CAST(sum(l.l_linenumber) AS BIGINT) AS s FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE l.l_quantity BETWEEN 5 AND 40 AND o.o_orderstatus IN ('F', 'O') AND c.c_mktsegment ILIKE '%i%' GROUP BY n.n_name HAVING count(*) > 10 ORDER BY n_items DESC, n.n_name LIMIT 10"),
    "flagship": ("SELECT n.n_name, COUNT(*) AS cnt, ROUND(SUM(o.o_totalprice), 2) AS total FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY n.n_name", "SELECT n.n_name, count(*) AS cnt, round(sum(o.o_totalprice), 2) AS total FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY n.n_name"),
}


def over(spark: SparkSession, sf_dir: str, table: str, columns: tuple[str, ...], statement: str, order: str | None = None, overflow: str = "error") -> DataFrame:
    """A statement over ``t``: columns of a table, made by Spark SQL before the dialect sees them."""
    frame, session = spark.read.parquet(f"{sf_dir}/{table}.parquet"), Session(spark)
    session.register("t", (frame.orderBy(order) if order else frame).selectExpr(*columns))
    return session.sql(statement, overflow)


def csv_text(spark: SparkSession, sf_dir: str, text: str, statement: str) -> DataFrame:
    """A statement over ``t``, loaded from a CSV file that holds ``text``."""
    path, session = scratch(spark, "text"), Session(spark)
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.text(path)
    session.load_csv(path, "t")
    return session.sql(statement)


def csv_tables(spark: SparkSession, sf_dir: str, columns: dict[str, tuple[str, ...]]) -> Session:
    """A session whose tables were written as CSV (the header in a file of its own) and loaded from there."""
    path, session = scratch(spark, "csv"), Session(spark)
    session.csv = {name: f"{path}/{name}/*" for name in columns}
    for name, some in columns.items():
        text = ["CAST({0} AS string) AS {0}".format(c) for c in some]
        spark.createDataFrame([(",".join(some),)], "value string").coalesce(1).write.text(f"{path}/{name}/0-head")
        spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*text).write.option("emptyValue", "").option("escape", '"').csv(f"{path}/{name}/1-rows")
        session.load_csv(session.csv[name], name)
    return session


def from_csv(spark: SparkSession, sf_dir: str, columns: dict[str, tuple[str, ...]], statement: str) -> DataFrame:
    return csv_tables(spark, sf_dir, columns).sql(statement)


def _case(statement: str, **how) -> Callable[[SparkSession, str], DataFrame]:
    return partial(_run_case, statement=statement, how=how)


def _run_case(spark: SparkSession, sf_dir: str, statement: str, how: dict) -> DataFrame:
    return run(spark, sf_dir, statement, **how)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _case(statement) for name, (statement, _) in CASES.items()}
SQL: dict[str, str] = {name: oracle for name, (_, oracle) in CASES.items()}

_JOINED = "SELECT n.n_name, COUNT(*) AS n FROM nation n JOIN supplier s ON n.n_nationkey = s.s_nationkey GROUP BY n.n_name"
for _mode in ("auto", "nested", "hash"):
    QUERIES[f"CMD-7_join_{_mode}"] = _case(_JOINED, mode=_mode)
    SQL[f"CMD-7_join_{_mode}"] = _JOINED
for _kind in ("hash", "sorted"):
    QUERIES[f"CMD-8_index_{_kind}"] = _case(CASES["SRC-11_index_scan"][0], index=("orders", "o_custkey", _kind))
    SQL[f"CMD-8_index_{_kind}"] = CASES["SRC-11_index_scan"][1]
QUERIES["JN-6_index"] = _case(CASES["JN-6_index"][0], index=("orders", "o_custkey", "hash"))
QUERIES["ART-6_overflow"] = _case(CASES["ART-6_overflow"][0], overflow="float")

# A column that is no key takes the value of the group's first row, and a limit the first rows; the input order is that of the key.
QUERIES["AGG-13_first_row"] = partial(over, table="orders", columns=("*",), order="o_orderkey", statement="SELECT o_custkey, o_orderkey, o_totalprice, COUNT(*) AS n FROM t GROUP BY o_custkey")
SQL["AGG-13_first_row"] = "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice, count(*) AS n FROM orders GROUP BY o_custkey"
QUERIES["LIM-2_unsorted"] = partial(over, table="orders", columns=("*",), order="o_orderkey", statement="SELECT o_orderkey, o_custkey FROM t WHERE o_totalprice > 100000 LIMIT 25")
SQL["LIM-2_unsorted"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 25"

# Sums above 2^53 stay exact; a total that leaves 64 bits is FLOAT where that is asked for.
_BIG = "CASE WHEN o_orderkey % 997 = 1 THEN 9007199254740993 ELSE o_orderkey END"
QUERIES["AGG-6_sum_exact"] = partial(over, table="orders", columns=("o_orderpriority AS p", f"{_BIG} AS v"), statement="SELECT p, SUM(v) AS s, SUM(DISTINCT v) AS d FROM t GROUP BY p")
SQL["AGG-6_sum_exact"] = f"SELECT o_orderpriority AS p, CAST(sum({_BIG}) AS BIGINT) AS s, CAST(sum(DISTINCT {_BIG}) AS BIGINT) AS d FROM orders GROUP BY o_orderpriority"
QUERIES["AGG-6_sum_overflow"] = _case("SELECT SUM(n_nationkey * 0 + 4611686018427387904) AS s FROM nation", overflow="float")
SQL["AGG-6_sum_overflow"] = "SELECT count(*) * CAST(4611686018427387904 AS DOUBLE) AS s FROM nation"

# Kinds of typed sources; NaN is null.
QUERIES["CMP-10_decimal"] = partial(over, table="orders", columns=("o_orderkey", "o_orderstatus AS st", "CAST(o_totalprice AS decimal(12,2)) AS v"), statement="SELECT st, COUNT(*) AS n, ROUND(SUM(v), 2) AS s, ROUND(MAX(v), 2) AS hi FROM t WHERE v > 100000.5 AND v <> 150000 GROUP BY st")
SQL["CMP-10_decimal"] = "SELECT o_orderstatus AS st, count(*) AS n, round(CAST(sum(v) AS DOUBLE), 2) AS s, CAST(max(v) AS DOUBLE) AS hi FROM (SELECT *, CAST(o_totalprice AS DECIMAL(12,2)) AS v FROM orders) WHERE v > 100000.5 AND v <> 150000 GROUP BY o_orderstatus"
QUERIES["CMP-11_boolean"] = partial(over, table="part", columns=("p_partkey", "p_size > 20 AS big"), statement="SELECT p_partkey, big FROM t WHERE big OR p_partkey < 50")
SQL["CMP-11_boolean"] = "SELECT p_partkey, CAST(p_size > 20 AS BIGINT) AS big FROM part WHERE p_size > 20 OR p_partkey < 50"
QUERIES["SRC-6_nan"] = partial(over, table="part", columns=("p_brand", "CASE WHEN p_size % 5 = 0 THEN double('NaN') ELSE p_retailprice END AS x"), statement="SELECT p_brand, COUNT(*) AS n, COUNT(x) AS k, MAX(x) AS hi, SUM(x IS NULL) AS none, SUM(x = x) AS own, SUM(x > 1200) AS dear FROM t GROUP BY p_brand")
SQL["SRC-6_nan"] = "SELECT p_brand, count(*) AS n, count(x) AS k, max(x) AS hi, CAST(sum(CAST(x IS NULL AS INT)) AS BIGINT) AS none, CAST(sum(CAST(x = x AS INT)) AS BIGINT) AS own, CAST(sum(CAST(x > 1200 AS INT)) AS BIGINT) AS dear FROM (SELECT p_brand, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS x FROM part) GROUP BY p_brand"
QUERIES["LIK-6_column"] = partial(over, table="part", columns=("p_partkey", "p_type", "concat(substr(p_type, 1, 2), '%', substr(p_brand, -1), '%_') AS pattern"), statement="SELECT p_partkey, p_type LIKE pattern AS a, pattern LIKE '%!_%' AS b, p_type NOT LIKE p_type AS c FROM t")
SQL["LIK-6_column"] = "SELECT p_partkey, CAST(p_type ILIKE concat(substr(p_type, 1, 2), '%', substr(p_brand, -1), '%_') AS BIGINT) AS a, CAST(concat(substr(p_type, 1, 2), '%', substr(p_brand, -1), '%_') ILIKE '%!_%' AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM part"

# CSV: whole tables written as text and loaded again, and small files with the odd cells.
_ORDERS, _CUSTOMER = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
QUERIES["SRC-1_csv_lines"] = partial(from_csv, columns={"orders": _ORDERS}, statement="SELECT * FROM orders")
SQL["SRC-1_csv_lines"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"
CSV_JOIN = "SELECT c_mktsegment, COUNT(*) AS n, SUM(o_custkey) AS k, ROUND(MAX(o_totalprice), 2) AS hi FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate >= '1994' GROUP BY c_mktsegment"
QUERIES["SRC-4_csv_join"] = partial(from_csv, columns={"orders": _ORDERS, "customer": _CUSTOMER}, statement=CSV_JOIN)
SQL["SRC-4_csv_join"] = "SELECT c_mktsegment, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS k, max(o_totalprice) AS hi FROM customer JOIN orders ON c_custkey = o_custkey WHERE CAST(o_orderdate AS VARCHAR) >= '1994' GROUP BY c_mktsegment"
_TEXTS = {
    "SRC-2_csv_quotes": ('id,name,note\n1,"Lee, Ann",plain\n2,"say ""hi""",\n3,"abc"def,x"y\n4,"open,end\n', "(1, 'Lee, Ann', 'plain'), (2, 'say \"hi\"', NULL), (3, 'abc', 'x\"y'), (4, 'open,end', NULL)", "id, name, note"),
    "SRC-3_csv_no_line_break": ('id,s\n1,"a\nb",2\n', "('1', 'a'), ('b\"', '2')", "id, s"),
    "SRC-5_csv_kinds": ("i,f,s,w,none\n 42,1e5,0x1A,99999999999999999999,\n+5,2,1.5,1,\n", "(42, CAST(1e5 AS DOUBLE), '0x1A', CAST(1e20 AS DOUBLE), CAST(NULL AS VARCHAR)), (5, CAST(2 AS DOUBLE), '1.5', CAST(1 AS DOUBLE), NULL)", "i, f, s, w, none"),
    "SRC-6_csv_cells": ("x,s\n5,a\nnan,\n-2.5,inf\n", "(CAST(5 AS DOUBLE), 'a'), (NULL, NULL), (-2.5, 'inf')", "x, s"),
    "SRC-7_csv_ragged": ("a,b\n1,2,3\n4\n", "(1, 2), (4, NULL)", "a, b"),
    "SRC-8_csv_blank": ("a,b\r\n1,x\r\n\r\n2,y\r\n", "(1, 'x'), (NULL, NULL), (2, 'y')", "a, b"),
}
for _name, (_text, _values, _columns) in _TEXTS.items():
    QUERIES[_name] = partial(csv_text, text=_text, statement=f"SELECT {_columns} FROM t")
    SQL[_name] = f"SELECT * FROM (VALUES {_values}) AS t({_columns})"
