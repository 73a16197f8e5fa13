"""The dialect's rules on small tables, as text in and text out."""

import time

import pytest

from tarn.repl import Done, command
from tarn.session import Session
from tarn.sql.errors import BindError, LoadError

MAX, MIN = 9223372036854775807, "(-9223372036854775807-1)"
FILES = {
    "simple": "id,name,age\n1,Ada,30\n2,Ben,25\n3,Cleo,41\n",
    "singers": "id,name\n1,Nadia Brook\n2,Ivo Reyes\n3,Petra Lang\n",
    "records": "record_id,singer_id,title,genre\n10,1,Dawn,Folk\n11,1,Ember,Folk\n12,2,Fjord,Folk\n13,2,Grove,Folk\n14,3,Harbour,Folk\n15,99,Stray Record,Polka\n",
    "one": "k\n1\n",
    "t": "i,n,f\n1,1,1\n2,,0\n3,,\n",
    "big": "v\n9007199254740993\n2\n",
    "huge": "v\n9223372036854775806\n9223372036854775806\n",
    "least": "v\n-9223372036854775808\n",
    "nan": "x\n5\nnan\n5\n",
    "infs": "x\ninf\n-inf\n",
    "a": "x\n1\n2\n3\n",
    "b": "y\n1\n2\n3\n",
    "c": "z\n1\n",
    "accents": "s\né\nE\n",
    "slow": "s\n" + "a" * 45 + "\n",
}


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    folder, s = tmp_path_factory.mktemp("csv"), Session(spark)
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
        s.load_csv(str(folder / f"{name}.csv"), name)
    return s


def rows(session, sql):
    return [tuple(r) for r in session.sql(sql).collect()]


def shown(session, sql):
    """The first cell, as the grid prints it."""
    return session.show(sql).split("\n")[3].strip()


@pytest.mark.parametrize(
    "expr, text",
    [
        (f"{MAX}+1", "9.22337e+18"), ("9223372036854775806*3", "2.76701e+19"), (f"-{MIN}", "9.22337e+18"), (f"{MIN}/-1", "9.22337e+18"),
        ("ROUND(1.5,2000000000)", "1.5"), ("ROUND(1000000000000000000.0,5)", "1e+18"), ("ROUND(2.675,2)", "2.67"), ("ROUND(2.5)", "3"),
        ("ROUND(0.125,2)", "0.13"), ("ROUND(0.25,1)", "0.3"), ("ROUND(1.5,NULL)", "NULL"), ("ROUND(2.567,2.0)", "2.57"), ("ROUND('abc')", "NULL"),
        ("ROUND(-0.25)", "0"), ("ROUND(-0.125,1)", "-0.1"), ("7/2", "3"), ("-7/2", "-3"), ("7/0", "NULL"), ("1.0/0", "NULL"), ("7/2.0", "3.5"),
        ("5 NOT BETWEEN 10 AND NULL", "NULL"), ("'a' NOT IN (1)", "1"), ("1 IN ()", "0"), ("NULL IN ()", "NULL"), ("2 IN (1, NULL)", "NULL"), ("'x' = 1", "NULL"),
        ("(1=1)+1", "2"), ("NOT 'text'", "1"), ("NOT NULL", "NULL"), ("LENGTH(1.50)", "3"), ("LENGTH(-12)", "3"), ("LENGTH('é')", "2"), ("UPPER('aé')", "Aé"),
        ("UPPER(5)", "5"), ("ABS(-3)", "3"), ("ABS('x')", "NULL"), ("COALESCE(NULL, 2)", "2"), ("COALESCE()", "NULL"), ("TRIM('  a ')", "a"), ("'a' + 1", "NULL"),
        ("'A_c' LIKE 'a_C'", "1"), ("'é' LIKE '_'", "0"), ("'é' LIKE '__'", "1"), ("'a\\b' LIKE 'a\\b'", "1"), ("5 LIKE '5'", "NULL"), ("'abc' LIKE '%'", "1"), ("1 < 2.5", "1"),
        ("'it''s'", "it's"), ("NULL", "NULL"), ("1 = 1.0", "1"), ("1 + 2 * 3 - -4", "11"), ("'' IS NULL", "0"),
    ],
)
def test_expressions(session, expr, text):
    assert shown(session, f"SELECT {expr} FROM one") == text


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT a.name, COUNT(*) FROM singers a JOIN records b ON a.id = b.singer_id WHERE b.genre = 'Folk' GROUP BY a.name ORDER BY 2 DESC, 1", [("Ivo Reyes", 2), ("Nadia Brook", 2), ("Petra Lang", 1)]),
        ("SELECT genre, COUNT(*) FROM records GROUP BY genre HAVING COUNT(*) >= 2", [("Folk", 5)]),
        ("SELECT COUNT(*), MIN(record_id), MAX(record_id) FROM records", [(6, 10, 15)]),
        ("SELECT b.title, a.name FROM records b LEFT JOIN singers a ON a.id = b.singer_id WHERE a.name IS NULL", [("Stray Record", None)]),
        ("SELECT COUNT(*) FROM a JOIN b ON x = y JOIN c ON y = z", [(1,)]),
        ("SELECT COUNT(*) FROM simple WHERE id = 2.0", [(1,)]),
        ("SELECT COUNT(*) FROM simple WHERE id NOT IN (1, NULL)", [(0,)]),
        ("SELECT COUNT(*) FROM t WHERE NOT (n = 1 OR f = 1)", [(0,)]),
        ("SELECT COUNT(*) FROM t WHERE NOT (n = 1 AND f = 1)", [(1,)]),
        ("SELECT SUM(v) FROM big", [(9007199254740995,)]),
        ("SELECT COUNT(*) FROM nan WHERE x IS NULL", [(1,)]),
        ("SELECT COUNT(*) FROM nan WHERE x = 5", [(2,)]),
        ("SELECT COUNT(*) FROM infs WHERE x - x IS NULL", [(2,)]),
        ("SELECT SUM(x) FROM infs", [(None,)]),
        ("SELECT COUNT(*) FROM slow WHERE s LIKE '" + "a%" * 12 + "b'", [(0,)]),
        ("SELECT name, COUNT(*) FROM simple WHERE id > 5", [(None, 0)]),
        ("SELECT title, genre FROM records GROUP BY genre", [("Dawn", "Folk"), ("Stray Record", "Polka")]),
        ("SELECT name FROM simple LIMIT 2", [("Ada",), ("Ben",)]),
        ("SELECT n FROM t ORDER BY n", [(None,), (None,), (1,)]),
        ("SELECT COUNT(DISTINCT genre), AVG(DISTINCT singer_id) FROM records WHERE genre = 'Folk'", [(1, 2.0)]),
        ("SELECT x.id, y.id FROM simple x JOIN simple y ON x.id < y.id ORDER BY 1, 2", [(1, 2), (1, 3), (2, 3)]),
        ("SELECT COUNT(*) FROM accents WHERE UPPER(s) = 'E'", [(1,)]),
        ("SELECT COUNT(*) FROM simple WHERE name = 5", [(0,)]),
        ("SELECT COUNT(*) FROM simple WHERE age", [(3,)]),
        ("SELECT COUNT(*) FROM simple WHERE name", [(0,)]),
    ],
)
def test_statements(session, sql, expected):
    out = rows(session, sql)
    assert out == expected if "ORDER BY" in sql or "LIMIT" in sql else sorted(map(str, out)) == sorted(map(str, expected))


@pytest.mark.parametrize(
    "line, phrase",
    [
        ("SELECT name AS n FROM simple WHERE n = 'Ada'", "no such column: n"),
        ("SELECT name, COUNT(*) AS cnt FROM simple GROUP BY name HAVING cnt >= 1", "no such column: cnt"),
        ("SELECT name FROM simple ORDER BY age", "not a selected column"),
        ("SELECT 'abc", "unterminated string literal"),
        (f"SELECT {'(' * 5000}1{')' * 5000} FROM one", "nested too deeply"),
        (f"SELECT {'abs(' * 50000}1 FROM one", "nested too deeply"),
        (f"SELECT {'1 IN (' * 20000}1 FROM one", "nested too deeply"),
        (f"SELECT {'-' * 5000}1 FROM one".replace("--", "- -"), "nested too deeply"),
        (".index simple id sroted", "unknown index type"),
        (".index simple id HASH", "index on simple.id"),
        ("SELECT bogus FROM simple", "bind error"),
        ("SELECT UPPER(citty) FROM simple", "bind error"),
        ("SELECT * FROM nowhere", "no such table"),
        ("SELECT s.id FROM simple x", "no such table or alias: s"),
        ("SELECT id FROM simple x JOIN simple y ON x.id = y.id", "ambiguous column"),
        ("SELECT COUNT(*) FROM simple JOIN simple ON 1 = 1", "ambiguous"),
        ("SELECT SUM(COUNT(*)) FROM simple", "bind error"),
        ("SELECT SUM(*) FROM simple", "bind error"),
        ("SELECT SUM(name) FROM simple", "bind error"),
        ("SELECT id FROM simple WHERE COUNT(*) > 1", "bind error"),
        ("SELECT nope(1) FROM one", "no such function"),
        ("SELECT ABS(1, 2) FROM one", "wrong number of arguments"),
        ("SELECT COALESCE(name, 1) FROM simple", "bind error"),
        ("SELECT id FROM simple ORDER BY 2", "out of range"),
        ("SELECT id FROM simple HAVING id > 1", "parse error"),
        ("SELECT 1", "parse error"),
        ("SELECT id FROM simple LEFT OUTER JOIN a ON 1 = 1", "parse error"),
        ("SELECT COUNT(DISTINCT *) FROM simple", "parse error"),
        ("SELECT 99999999999999999999 FROM one", "out of range"),
        ("SELECT id % 2 FROM simple", "unexpected character"),
        ("SELECT a.x AS y FROM a ORDER BY a.x", "not a selected column"),
        (".nonsense", "unknown command"),
        (".ast SELECT id FROM simple WHERE NOT id IN (1)", "WHERE NOT (id IN (1))"),
        (".schema simple", "name STRING"),
        (".dump simple", "(3 rows)"),
        (".tables", "simple (3 rows)"),
        (".plan SELECT COUNT(*) FROM singers a JOIN records b ON a.id = b.singer_id", "[hash]"),
        (".join sideways", "unknown join mode"),
        (".help", ".load"),
    ],
)
def test_shell(session, line, phrase):
    assert phrase in command(session, line)


def test_quit(session):
    with pytest.raises(Done):
        command(session, ".quit")


@pytest.mark.parametrize("mode", ["auto", "nested", "hash"])
def test_join_modes_agree(session, mode):
    session.set_join_mode(mode)
    try:
        assert rows(session, "SELECT COUNT(*) FROM singers a JOIN records b ON a.id = b.singer_id WHERE a.id < 3") == [(4,)]
        assert rows(session, "SELECT COUNT(*) FROM records b LEFT JOIN singers a ON a.id = b.singer_id") == [(6,)]
    finally:
        session.set_join_mode("auto")


def test_many_joins(session):
    joins = " ".join(f"JOIN c c{i} ON c0.z = c{i}.z" for i in range(1, 31))
    assert rows(session, f"SELECT COUNT(*) FROM c c0 {joins}") == [(1,)]


def test_plans_keep_keys_and_top_k(session):
    plan = session.plan("SELECT a.name, b.title FROM singers a JOIN records b ON a.id = b.singer_id ORDER BY 1, 2 LIMIT 2")
    assert "TakeOrderedAndProject" in plan and "HashJoin" in plan and "Python" not in plan


def load(session, tmp_path, text, name="x"):
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    session.load_csv(str(path), name)
    return session.schema(name), [tuple(r) for r in session.sql(f"SELECT * FROM {name}").collect()]


@pytest.mark.parametrize(
    "text, kinds, expected",
    [
        ("a,b\n1,x\n\n2,y\n", ["INT", "STRING"], [(1, "x"), (None, None), (2, "y")]),
        ('a,b\n"",1\n"abc"def,2\nab"c,3\n"un,closed\n', ["STRING", "INT"], [(None, 1), ("abc", 2), ('ab"c', 3), ("un,closed", None)]),
        ("a\n 42\n+5\n", ["INT"], [(42,), (5,)]),
        ("a\n42 \n5\n", ["STRING"], [("42 ",), ("5",)]),
        ("a\n1e5\n2\n", ["FLOAT"], [(1e5,), (2.0,)]),
        ("a\n0x1A\n", ["STRING"], [("0x1A",)]),
        ("a\n1e400\n", ["STRING"], [("1e400",)]),
        ("a\n99999999999999999999\n1\n", ["FLOAT"], [(1e20,), (1.0,)]),
        ("a,b\r\n1,x\r\n", ["INT", "STRING"], [(1, "x")]),
        ("a\nx\ry\n", ["STRING"], [("x\ry",)]),
        ("a,b\n", ["STRING", "STRING"], []),
        ('a,b\n"x ""y"" z",1\n', ["STRING", "INT"], [('x "y" z', 1)]),
        ("a\ntrue\nfalse\n", ["STRING"], [("true",), ("false",)]),
        ("a,b\na,b\n1,2\n", ["STRING", "STRING"], [("a", "b"), ("1", "2")]),
    ],
)
def test_csv(session, tmp_path, text, kinds, expected):
    schema, got = load(session, tmp_path, text)
    assert [k for _, k in schema] == kinds
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_csv_errors(session, tmp_path):
    with pytest.raises(LoadError):
        session.load_csv(str(tmp_path / "missing.csv"), "m")
    with pytest.raises(LoadError):
        load(session, tmp_path, "")
    with pytest.warns(UserWarning) as told:
        load(session, tmp_path, "a,b\n1,Ada\n" + "2,Ben,EXTRA\n" * 7)
    assert [str(w.message).split("x.csv")[1] for w in told if "x.csv" in str(w.message)] == [f" row {i} has 3 fields, expected 2 (extra dropped)" for i in range(3, 8)] + [": 2 more rows with extra fields"]
    with pytest.raises(BindError):
        session.table("m")


def test_sequential_keys(session, tmp_path):
    for name, column in (("l", "k"), ("r", "ref")):
        (tmp_path / f"{name}.csv").write_text("\n".join([column, *map(str, range(50000))]) + "\n")
    rows(session, "SELECT COUNT(*) FROM one")
    began = time.time()
    for name in ("l", "r"):
        session.load_csv(str(tmp_path / f"{name}.csv"), name)
    assert rows(session, "SELECT COUNT(*) FROM l JOIN r ON l.k = r.ref") == [(50000,)]
    assert time.time() - began < 5


@pytest.mark.parametrize("pattern", ["'" + "a%" * 12 + "b'", "p"])
def test_like_is_not_exponential(session, spark, pattern):
    session.register("patterns", spark.createDataFrame([("a" * 45, "%" + "a%" * 12 + "b")], "s string, p string"))
    began = time.time()
    assert rows(session, f"SELECT COUNT(*) FROM patterns WHERE s LIKE {pattern}") == [(0,)]
    assert time.time() - began < 5


def test_like_column_patterns(session, spark):
    patterns = ["", "%", "%%", "a%", "%c", "a%c", "%b%", "a_c", "abc", "a%b%c", "ABC", "_%_", "a.c", "%a.c%", "(%", "a\\%", "%x%c"]
    texts = ["", "abc", "a.c", "xabcx", "(abc", "a\\c", "é"]
    session.register("both", spark.createDataFrame([(s, p) for s in texts for p in patterns], "s string, p string"))
    got = {(r.s, r.p): r.x for r in session.sql("SELECT s, p, s LIKE p AS x FROM both").collect()}
    for p in patterns:
        quoted = p.replace("'", "''")
        assert {s: got[s, p] for s in texts} == {r.s: r.x for r in session.sql(f"SELECT s, s LIKE '{quoted}' AS x FROM both").collect()}, p


def test_sums_are_exact_and_types_fixed(session, spark):
    started = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    session.register("ints", spark.createDataFrame([(9007199254740993,)] + [(0,)] * 1999, "v long"))
    session.register("mixed", spark.createDataFrame([(9223372036854775807,), (9223372036854775807,), (-9223372036854775807,), (-5,)], "v long"))
    before = started()
    frames = [session.sql(f"SELECT SUM(v) AS s, SUM(DISTINCT v) AS d FROM {t}") for t in ("ints", "mixed", "huge")]
    session.plan("SELECT SUM(v + 1) FROM ints")
    assert started() == before
    assert all(str(f.schema["s"].dataType) == "LongType()" for f in frames)
    assert [tuple(f.head()) for f in frames[:2]] == [(9007199254740993,) * 2, (9223372036854775802, -5)]
    with pytest.raises(Exception, match="leaves 64 bits"):
        frames[2].collect()
    with pytest.raises(Exception, match="leaves 64 bits"):
        session.sql("SELECT ABS(v) FROM least").collect()
    wide = lambda sql: [tuple(r) for r in session.sql(sql, overflow="float").collect()]
    assert wide("SELECT SUM(v) FROM huge") == [(1.8446744073709552e19,)] and wide("SELECT ABS(v) FROM least") == [(9.223372036854775808e18,)]
    assert shown(session, "SELECT SUM(v) FROM huge") == "1.84467e+19" and shown(session, "SELECT ABS(v) FROM least") == "9.22337e+18"
    assert shown(session, "SELECT v / -1 FROM least") == "9.22337e+18" and shown(session, "SELECT -v FROM least") == "9.22337e+18" and shown(session, "SELECT v * 2 - v FROM huge") == "9.22337e+18"


def test_kinds_of_typed_sources(session, spark):
    rows_ = [(True, "1.50", "1995-06-01", "1995-06-01 12:00:00", float("nan"), [1]), (False, "2.25", "1996-01-01", "1996-01-01 00:00:00", 5.0, [2]), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows_, "b boolean, dec string, d string, ts string, x double, l array<int>")
    session.register("typed", frame.selectExpr("b", "CAST(dec AS decimal(9,2)) AS dec", "CAST(d AS date) AS d", "CAST(ts AS timestamp) AS ts", "CAST(ts AS timestamp_ntz) AS tn", "x", "l"))
    one = lambda where: rows(session, f"SELECT COUNT(*) FROM typed WHERE {where}")[0][0]
    assert [k for _, k in session.schema("typed")] == ["INT", "DECIMAL", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "FLOAT", "OTHER"]
    assert one("b") == 1 and one("NOT b") == 1 and one("b = 1") == 1 and one("b + 1 = 2") == 1
    assert one("dec > 2") == 1 and one("dec = 1.5") == 1 and one("dec + 0.5 = 2") == 1 and one("dec IN (1.5, 2.25)") == 2
    assert one("d > '1995-06-01'") == 1 and one("d BETWEEN '1995-01-01' AND '1995-12-31'") == 1 and one("d IN ('1996-01-01')") == 1
    assert one("ts > '1995-06-01'") == 2 and one("tn <= '1995-06-01 12:00:00'") == 1 and one("ts >= d") == 2 and one("d < '1995-06-01 06:00:00'") == 1
    assert one("x IS NULL") == 2 and one("x = x") == 1 and one("NOT x > 7") == 1
    assert rows(session, "SELECT MAX(x), COUNT(x), SUM(dec), MIN(d) IS NULL FROM typed")[0][:2] == (5.0, 1)
    assert "3.75" in session.show("SELECT SUM(dec) FROM typed") and "DECIMAL" in session.show("SELECT SUM(dec) FROM typed")
    assert rows(session, "SELECT COUNT(*) FROM typed a JOIN typed b ON a.d = b.d") == [(2,)]
    for bad in ("d > 5", "d = ts + 1", "l = l", "d", "SUM(d) > 1", "d > 'soon'", "d LIKE '1%'", "COALESCE(d, 1) IS NULL", "l > 1"):
        with pytest.raises(BindError):
            rows(session, f"SELECT COUNT(*) FROM typed WHERE {bad}")


def test_limit_reads_no_more_than_it_needs(session):
    plan = session.plan("SELECT name FROM simple WHERE age > 1 LIMIT 2")
    assert "CollectLimit" in plan and "TakeOrdered" not in plan and "Exchange" not in plan


def test_float_filter_reaches_the_scan(session, spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0)], "x double, y double").write.parquet(str(tmp_path / "p"))
    session.load_parquet(str(tmp_path / "p"), "floats")
    plan = session.plan("SELECT COUNT(*) FROM floats WHERE x > 25 AND y < 3")
    assert "GreaterThan(x,25.0)" in plan and "LessThan(y,3.0)" in plan
