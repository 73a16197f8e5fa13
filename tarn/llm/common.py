"""What the operators share: scratch folders, row ids, files, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove, saved, scratch, shared_folder  # noqa: F401

#: Word rules.  Both work on UTF-8 bytes, where every byte of a non-ASCII code point is >= 0x80.
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
ALNUM_TABLE = bytes(b if b in _KEEP else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(ALNUM_TABLE).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased (bytes.split() and lower() are ASCII only)."""
    return text.lower().split()


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; a plain path is local."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def named(c: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + c.replace("`", "``") + "`")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(named(c).cast("string"), F.lit(""))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores at its end as no column of ``taken`` has (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the columns c0, c1, ...: no name of theirs can be mistaken for one of ours, or hold a dot."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def _file_rows(df: DataFrame) -> bool:
    """Whether df is rows of files, each once: a scan below deterministic selections and filters alone."""
    if "_metadata" in (c.lower() for c in df.columns):
        return False
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "HadoopFsRelation" not in plan.relation().getClass().getName():
        return False
    roots = plan.relation().location().rootPaths()
    return len({roots.apply(i).toString() for i in range(roots.size())}) == roots.size()


def keyed(df: DataFrame, name: str) -> DataFrame:
    """df with a unique struct<f: long, i: long> per row that is the same each time the rows are read.

    Rows of a file have the hash of the file's path and their place in it.  Any other DataFrame (made rows,
    exploded or joined ones, a file read twice) is written once with generated ids: those depend on how the rows
    are dealt, so they hold only for the written copy.  ``name`` must not be a column of df (see ``fresh``).
    """
    if _file_rows(df):
        with contextlib.suppress(AnalysisException):  # a format without row places
            return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias(name))
    made = F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("i"))
    return saved(df.withColumn(name, made), scratch(df.sparkSession, "keyed"))


def rows_of(docs: DataFrame, key: str | None, **columns: str) -> DataFrame:
    """Columns of docs under other names, and ``f`` and ``i``: the parts of the key column, or of a key made here."""
    picked = docs.select(*(named(c).alias(n) for n, c in columns.items()), *([named(key).alias("key")] if key else []))
    return (picked if key else keyed(picked, "key")).select(*columns, F.col("key.f").alias("f"), F.col("key.i").alias("i"))


def small_side(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """``keys``, a written table of fixed-size rows, as the side of a join: broadcast if it has at most ``most`` rows."""
    return F.broadcast(keys) if keys.count() <= most else keys


def without(docs: DataFrame, gone_of, **columns: str) -> DataFrame:
    """docs without some rows, each found by its key whatever its columns are.

    ``gone_of(small, key)`` gets the given columns under the given names, and the name of their key; it returns
    the keys (f, i) of the rows that go.  Those are written; the documents themselves never leave the JVM, and
    are shuffled only where the keys are too many to broadcast.
    """
    rows = keyed(numbered(docs), "row")
    small = rows.select(*(F.col(f"c{docs.columns.index(c)}").alias(n) for n, c in columns.items()), F.col("row").alias("key"))
    with small_batches(docs.sparkSession):
        gone = saved(gone_of(small, "key").select(F.struct("f", "i").alias("row")), scratch(docs.sparkSession, "gone"))
    return rows.join(small_side(gone), "row", "left_anti").drop("row").toDF(*docs.columns)


def as_bytes(col: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8 bytes, null as b''."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """What is free in this worker goes back to the system: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What operators remember in a worker between tasks: owner -> how to forget it.
FORGET: dict[str, list] = {}


def claim(owner: str | None = None) -> None:
    """This worker now works for ``owner``: what others remembered here goes, workers are kept for all stages."""
    for name, ways in FORGET.items():
        if name != owner:
            for forget in ways:
                forget()
    give_back()


def pieces(batches, rows: int = 512, owner: str | None = None):
    """The batches in slices of at most ``rows`` rows, so that a task holds few texts as Python objects at once."""
    claim(owner)
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    batch = None
    give_back()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Inside, actions send Arrow batches of at most ``rows`` rows; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}


def arrow_schema(ddl: str, **types: pa.DataType) -> pa.Schema:
    """Arrow schema of a flat DDL string; arrays of simple types too.  Needs no JVM, so workers can call it.

    ``types`` gives the Arrow types of fields whose type is only known from the data, as of ids.
    """
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(pa.field(name, types[name] if name in types else pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]))
    return pa.schema(fields)


_TABLES: dict[int, list[int]] = {}


def _gf2_times(mat: list[int], vec: int) -> int:
    total, i = 0, 0
    while vec:
        if vec & 1:
            total ^= mat[i]
        vec >>= 1
        i += 1
    return total


def _zeros_operator(k: int) -> list[int]:
    """The matrix over GF(2) that appends 2**k zero bytes to a CRC-32."""
    if k not in _TABLES:
        if k == 0:
            mat = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
            for _ in range(3):
                mat = [_gf2_times(mat, x) for x in mat]
        else:
            half = _zeros_operator(k - 1)
            mat = [_gf2_times(half, x) for x in half]
        _TABLES[k] = mat
    return _TABLES[k]


@cache
def _zeros_by_byte(k: int) -> list[list[int]]:
    """The same operator as four tables, one per byte of the CRC."""
    mat = _zeros_operator(k)
    return [[_gf2_times(mat[8 * j : 8 * j + 8], b) for b in range(256)] for j in range(4)]


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of A+B from those of A and B and the length of B."""
    k = 0
    while second_bytes:
        if second_bytes & 1:
            t0, t1, t2, t3 = _zeros_by_byte(k)
            first = t0[first & 255] ^ t1[first >> 8 & 255] ^ t2[first >> 16 & 255] ^ t3[first >> 24]
        second_bytes >>= 1
        k += 1
    return first ^ second


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """Word (bytes) -> 64-bit hash, remembered up to a bound; ``ids(words)`` gives them as uint64."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.bound:
            self.clear()
        self[word] = h
        return h

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def prefix_sums(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, sum of value over all smaller keys).  df has one row per task or block, not per document."""
    from pyspark.sql import Window

    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(key, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias(out))
