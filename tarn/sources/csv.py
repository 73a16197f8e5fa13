"""CSV files by the dialect's rules.

Lines end at \\n, trailing \\r are dropped, a blank line is a row.  A field is quoted only if a quote is its
first character; "" is a quote, text after a closing quote is dropped, an open quote runs to the line's end.
Empty cells are null, quoted or not.  Every row votes on a column's type: INT, else FLOAT, else STRING.
"""

from __future__ import annotations

import re
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import ROW, Table
from ..shared import saved, scratch
from ..sql.errors import LoadError

_FIELD = r""",("[^"]*+(?:""[^"]*+)*+(?:"[^,]*|$)|[^,]*)"""
_QUOTED = r"""^"([^"]*+(?:""[^"]*+)*+)(?:"[^,]*)?$"""
_INT = r"^[ \t\n\x0B\f\r]*[+-]?[0-9]+$"
_FLOAT = r"(?i)^[ \t\n\x0B\f\r]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"
_SPELLED = r"(?i)^[ \t\n\x0B\f\r]*[+-]?(?:inf|infinity|nan)$"
_LEADING = r"^[ \t\n\x0B\f\r]+"


def split_fields(line: Column) -> Column:
    plain = F.split(line, ",", -1)
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    unquoted = lambda f: F.replace(F.regexp_replace(f, _QUOTED, "$1"), F.lit('""'), F.lit('"'))
    quoted = F.transform(raw, lambda f: F.when(F.startswith(f, F.lit('"')), unquoted(f)).otherwise(f))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def _number(f: Column) -> Column:
    bare = F.regexp_replace(f, _LEADING, "")
    low = F.lower(F.regexp_replace(bare, r"^[+-]", ""))
    sign = F.when(F.startswith(bare, F.lit("-")), -1.0).otherwise(1.0)
    spelled = F.when(low.startswith("inf"), sign * F.lit(float("inf")))
    return F.when(f.rlike(_SPELLED), spelled).otherwise(bare.try_cast("double"))


def _int_cell(f: Column) -> Column:
    return F.when(f.rlike(_INT), F.regexp_replace(f, _LEADING, "").try_cast("bigint"))


def _is_float(f: Column) -> Column:
    value = F.regexp_replace(f, _LEADING, "").try_cast("double")
    digits = F.regexp_replace(F.lower(f), r"e.*$", "")
    underflow = (value == 0.0) & digits.rlike("[1-9]")
    return f.rlike(_FLOAT) & (f.rlike(_SPELLED) | (value.isNotNull() & (F.abs(value) < F.lit(float("inf"))) & ~underflow))


def _code(f: Column) -> Column:
    """What a cell needs: 0 nothing, 1 INT, 2 FLOAT, 3 STRING."""
    return F.when(f.isNull() | (f == ""), 0).when(_int_cell(f).isNotNull(), 1).when(_is_float(f), 2).otherwise(3)


def _warn_ragged(path: str, lines: DataFrame, wide: Column, columns: int, n: int) -> None:
    first = lines.where(wide).select(ROW, F.size("f").alias("n")).orderBy(ROW).limit(5).collect()
    at = lines.agg(*(F.count_if(F.col(ROW) <= r[ROW]) for r in first)).head()
    for r, line in zip(first, at, strict=True):
        warnings.warn(f"{path} row {line} has {r['n']} fields, expected {columns} (extra dropped)", stacklevel=3)
    if n > len(first):
        warnings.warn(f"{path}: {n - len(first)} more rows with extra fields", stacklevel=3)


def load_csv(spark: SparkSession, path: str, name: str) -> Table:
    """Read a file (or a folder of them, with one header, in the first by name) into a typed table.

    One pass finds the columns' kinds, a second one writes the typed rows, with their places, as Parquet in the
    shared folder: statements then prune columns and push filters down instead of parsing text again.
    """
    try:
        text = spark.read.text(path, lineSep="\n")
        head = None
        for file in sorted(text.inputFiles()):
            if head := spark.read.text(file, lineSep="\n").select("value", "_metadata.file_path").head():
                break
    except AnalysisException as e:
        raise LoadError(f"cannot read {path}") from e
    if head is None:
        raise LoadError(f"{path} is empty")
    # The header is the first row of the first file's first block; a row that repeats its text is data.
    like_head = (F.col("value") == head["value"]) & (F.col("_metadata.file_path") == head["file_path"]) & (F.col("_metadata.file_block_start") == 0)
    lines = text.select(split_fields(F.regexp_replace("value", r"\r+$", "")).alias("f"), F.monotonically_increasing_id().alias(ROW), like_head.alias("head"))
    names = spark.createDataFrame([(head["value"],)], "value string").select(split_fields(F.regexp_replace("value", r"\r+$", ""))).head()[0]
    cell, wide = (lambda i: F.get("f", F.lit(i))), F.size("f") > len(names)

    def survey(rows: DataFrame, of: Column):
        return rows.agg(F.count_if(of), F.count_if(of & wide), F.min(F.when(F.col("head"), F.col(ROW))), F.count_if("head"), *(F.max(F.when(of, _code(cell(i)))) for i in range(len(names)))).head()

    got = survey(lines, ~F.col("head"))
    data = F.col(ROW) != got[2]
    if got[3] > 1:
        got = survey(lines, data)
    if got[1]:
        _warn_ragged(path, lines, data & wide, len(names), got[1])
    read = {1: _int_cell, 2: _number}
    columns = []
    for i, code in enumerate(got[4:]):
        filled = F.when(cell(i) != "", cell(i))
        columns.append(read.get(code, lambda f: f)(filled).alias(f"c{i}"))
    rows = saved(lines.where(data).select(*columns, ROW), scratch(spark, f"csv-{re.sub(r'[^A-Za-z0-9_]', '_', name)}"))
    return Table(name, rows.toDF(*names, ROW), ordered=True, clean=True, rows=got[0])
