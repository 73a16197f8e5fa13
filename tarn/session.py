"""The session: a catalog of tables, settings, and statements."""

from __future__ import annotations

import contextlib
import io
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .functions.exprs import OVERFLOW, WIDE
from .operators.catalog import ROW, Table
from .operators.lower import Lowering, Output
from .render import grid
from .sources.csv import load_csv
from .sources.parquet import load_parquet
from .sql.errors import BindError, DialectError
from .sql.parser import parse

JOIN_MODES, INDEX_KINDS = ("auto", "nested", "hash"), ("hash", "sorted")


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, {}
        self.join_mode, self.auto_index, self.timer = "auto", False, False
        self.indexes: list[tuple[str, str, str]] = []

    # tables

    def load_csv(self, path: str, name: str) -> int:
        self.catalog[name] = load_csv(self.spark, path, name)
        return self.catalog[name].rows

    def load_parquet(self, path: str, name: str) -> None:
        self.catalog[name] = load_parquet(self.spark, path, name)

    def register(self, name: str, frame: DataFrame) -> None:
        self.catalog[name] = Table(name, frame)

    def table(self, name: str) -> Table:
        if name not in self.catalog:
            raise BindError(f"no such table: {name}")
        return self.catalog[name]

    def tables(self) -> list[tuple[str, int]]:
        return [(n, t.row_count()) for n, t in self.catalog.items()]

    def schema(self, name: str) -> list[tuple[str, str]]:
        return [(c, k) for c, k in self.table(name).kinds.items()]

    def dump(self, name: str) -> str:
        t = self.table(name)
        frame = t.frame.orderBy(ROW).drop(ROW) if t.ordered else t.frame
        return grid(t.columns, [k for k in t.kinds.values()], frame.collect())

    # statements

    def _lowered(self, text: str, wide: bool = False) -> tuple[DataFrame, list[Output], Lowering]:
        lowering, before = Lowering(self.catalog, self.join_mode), WIDE.set(wide)
        try:
            frame, outputs = lowering.select(parse(text))
        finally:
            WIDE.reset(before)
        return frame, outputs, lowering

    def sql(self, text: str, overflow: str = "error") -> DataFrame:
        """The statement as a DataFrame; no job is started, and its types depend on kinds alone.

        A row whose INT arithmetic or SUM leaves 64 bits is an error when the DataFrame runs.  With
        ``overflow="float"`` all INT operations that may leave 64 bits are FLOAT, exact up to 2^53.
        """
        if overflow not in ("error", "float"):
            raise DialectError(f"unknown overflow mode: {overflow}")
        return self._lowered(text, overflow == "float")[0]

    def show(self, text: str) -> str:
        """The result as a grid; a statement that leaves 64 bits is run again with FLOAT in its place."""
        frame, outputs, _ = self._lowered(text)
        try:
            rows = frame.collect()
        except PySparkException as e:
            if OVERFLOW not in str(e):
                raise
            frame, outputs, _ = self._lowered(text, wide=True)
            rows = frame.collect()
        return grid([o.name for o in outputs], [o.value.kind for o in outputs], rows)

    def ast(self, text: str) -> str:
        return str(parse(text))

    def plan(self, text: str) -> str:
        frame, _, lowering = self._lowered(text)
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            frame.explain("formatted")
        return "\n".join([*lowering.notes, out.getvalue()])

    # settings: none of them changes a result

    def set_join_mode(self, mode: str) -> None:
        if mode not in JOIN_MODES:
            raise DialectError(f"unknown join mode: {mode}")
        self.join_mode = mode

    def index(self, table: str, column: str, kind: str = "hash") -> None:
        """Advisory: checks table, column and kind, and notes them in ``indexes``; plans and results stay as they are."""
        if kind.lower() not in INDEX_KINDS:
            raise DialectError(f"unknown index type: {kind}")
        t = self.table(table)
        if column not in t.kinds:
            raise BindError(f"no such column: {column}")
        self.indexes.append((table, column, kind.lower()))

    def timed(self, text: str) -> tuple[str, float]:
        began = time.perf_counter()
        out = self.show(text)
        return out, (time.perf_counter() - began) * 1000
