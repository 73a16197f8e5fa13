"""Tables that statements can name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_INTEGERS = {T.BooleanType: 1, T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_OTHERS = {T.StringType: "STRING", T.VarcharType: "STRING", T.CharType: "STRING", T.FloatType: "FLOAT", T.DoubleType: "FLOAT", T.DecimalType: "DECIMAL", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP_NTZ"}
ROW = "__row"  # hidden place of a row in input order


def kind_of(data_type: T.DataType) -> str:
    """INT, FLOAT, STRING, DECIMAL, DATE, TIMESTAMP or TIMESTAMP_NTZ; OTHER for what only passes through."""
    return "INT" if type(data_type) in _INTEGERS else _OTHERS.get(type(data_type), "OTHER")


def range_of(data_type: T.DataType) -> tuple[int, int]:
    """The least and greatest value of an integer type; a boolean is 0 or 1."""
    bits = _INTEGERS[type(data_type)]
    return (0, 1) if bits == 1 else (-(1 << bits - 1), (1 << bits - 1) - 1)


@dataclass
class Table:
    """A DataFrame and its columns' kinds."""

    name: str
    frame: DataFrame
    ordered: bool = False  # frame has the column ROW, as its last
    clean: bool = False  # FLOAT columns hold no NaN
    rows: int | None = None
    kinds: dict[str, str] = field(init=False)

    def __post_init__(self):
        self.fields = self.frame.schema.fields[: -1 if self.ordered else None]
        self.kinds = {f.name: kind_of(f.dataType) for f in self.fields}

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def row_count(self) -> int:
        if self.rows is None:
            self.rows = self.frame.count()
        return self.rows
