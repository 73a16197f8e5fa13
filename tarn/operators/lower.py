"""Syntax tree -> DataFrame: names are resolved, kinds checked, and every clause becomes a DataFrame operation.

Catalyst does the rest: pushdown, pruning, join order and strategy, partial aggregation, top-k.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sql import tree as S
from ..sql.errors import BindError
from .catalog import Table, kind_of, range_of


@dataclass(frozen=True)
class Field:
    qualifier: str
    name: str
    physical: str
    kind: str
    low: int = E.LOW
    high: int = E.HIGH
    raw: str | None = None  # the column as stored, where NaN is not yet null

    @property
    def value(self) -> E.Value:
        return E.Value(F.col(self.physical), self.kind, self.low, self.high)


class Scope:
    def __init__(self, fields: list[Field]):
        self.fields = fields

    def find(self, c: S.Column) -> Field:
        if c.table is not None and all(f.qualifier != c.table for f in self.fields):
            raise BindError(f"no such table or alias: {c.table}")
        hits = [f for f in self.fields if f.name == c.name and c.table in (None, f.qualifier)]
        if not hits:
            raise BindError(f"no such column: {c}")
        if len(hits) > 1:
            raise BindError(f"ambiguous column: {c}")
        return hits[0]


@dataclass(frozen=True)
class Output:
    name: str
    qualifier: str | None
    value: E.Value


class Lowering:
    def __init__(self, tables: dict[str, Table], join_mode: str = "auto"):
        self.tables, self.join_mode, self.refs, self.notes = tables, join_mode, 0, []

    # sources

    def table(self, ref: S.Table, need_rows: bool) -> tuple[DataFrame, list[Field], str]:
        if ref.name not in self.tables:
            raise BindError(f"no such table: {ref.name}")
        table, k = self.tables[ref.name], self.refs
        self.refs += 1
        fields, cols = [], []
        for i, f in enumerate(table.fields):
            physical, kind = f"t{k}_{i}", kind_of(f.dataType)
            low, high = range_of(f.dataType) if kind == "INT" else (E.LOW, E.HIGH)
            raw = f"{physical}_raw" if kind == "FLOAT" and not table.clean else None
            fields.append(Field(ref.qualifier, f.name, physical, kind, low, high, raw))
            col = F.col(physical)
            if kind == "INT":
                col = col.cast("int").cast("bigint") if f.dataType.typeName() == "boolean" else col.cast("bigint")
            elif kind == "FLOAT":
                col = col.cast("double")
                if raw:
                    cols.append(col.alias(raw))
                    col = E.no_nan(col)
            cols.append(col.alias(physical))
        row = f"t{k}_row"
        if need_rows:
            cols.append((F.col(row) if table.ordered else F.monotonically_increasing_id()).alias(row))
        return table.frame.toDF(*(f.physical for f in fields), *([row] if table.ordered else [])).select(*cols), fields, row

    def join(self, left: DataFrame, right: DataFrame, j: S.Join, scope: Scope) -> DataFrame:
        on = E.truth(self.value(j.on, scope))
        equi = isinstance(j.on, S.Binary) and j.on.op == "=" and isinstance(j.on.left, S.Column) and isinstance(j.on.right, S.Column)
        mode = "nested" if self.join_mode == "nested" or not equi else "hash"
        self.notes.append(f"{'LEFT' if j.left else 'INNER'} JOIN {j.table} ON {j.on} [{mode}]")
        if self.join_mode == "nested" and not j.left:
            right = right.hint("shuffle_replicate_nl")
        elif self.join_mode == "hash":
            right = right.hint("shuffle_hash")
        return left.join(right, on, "left" if j.left else "inner")

    def counted(self, s: S.Select, left: list[Field], right: list[Field]) -> list[Field] | None:
        """The fields in use, if the statement only counts the rows of one inner join on equal columns; else None.

        Such a join can meet distinct rows that know their number.  Functions and LIKE may tell equal values apart
        (0.0 and -0.0), so they leave the rows as they are.
        """
        scope = Scope(left + right)

        def equal(e: S.Node) -> bool:
            if isinstance(e, S.Binary) and e.op == "and":
                return equal(e.left) and equal(e.right)
            if not (isinstance(e, S.Binary) and e.op == "=" and isinstance(e.left, S.Column) and isinstance(e.right, S.Column)):
                return False
            return (scope.find(e.left) in left) != (scope.find(e.right) in left)

        if self.join_mode != "auto" or len(s.joins) != 1 or s.joins[0].left or not equal(s.joins[0].on):
            return None
        whole = [s.joins[0].on, *(i.expr for i in s.items), *s.group, *(e for e in (s.where, s.having) if e is not None)]
        nodes = [n for e in whole for n in S.walk(e)]
        if any(isinstance(n, S.Call | S.Like) or isinstance(n, S.Aggregate) and n.name != "count" for n in nodes):
            return None
        used = list(dict.fromkeys(scope.find(n) for n in nodes if isinstance(n, S.Column)))
        return None if any(f.kind == "OTHER" for f in used) else used

    def merged(self, frame: DataFrame, fields: list[Field], used: list[Field], where: S.Node | None, scope: Scope, number: str) -> DataFrame:
        """Distinct rows of the fields in use, with the number of rows that each stands for."""
        for raw, bare in self.pushable(where, scope):
            if any(f.raw == raw for f in fields):
                frame = frame.filter(bare)
        return frame.groupBy(*(f.physical for f in fields if f in used)).agg(F.count(F.lit(1)).alias(number))

    # expressions

    def value(self, e: S.Node, scope: Scope, known: dict[S.Node, E.Value] | None = None) -> E.Value:
        if known is not None and e in known:
            return known[e]
        go = lambda x: self.value(x, scope, known)
        match e:
            case S.Literal():
                return E.literal(e.value)
            case S.Column():
                return scope.find(e).value
            case S.Aggregate():
                raise BindError(f"aggregate not allowed here: {e}")
            case S.Binary(op=op):
                a, b = go(e.left), go(e.right)
                if op in ("and", "or"):
                    return E.logic(op, a, b)
                return E.compare(op, a, b) if op in E._COMPARE else E.arithmetic(op, a, b)
            case S.Unary(op=op):
                return E.negate(go(e.of)) if op == "not" else E.minus(go(e.of))
            case S.IsNull():
                return E.is_null(go(e.of), e.negated)
            case S.In():
                return E.within(go(e.of), [go(i) for i in e.items], e.negated)
            case S.Between():
                return E.between(go(e.of), go(e.low), go(e.high), e.negated)
            case S.Like():
                return E.like(go(e.of), go(e.pattern), e.negated)
            case S.Call():
                return E.call(e.name, [go(a) for a in e.args])
        raise BindError(f"cannot evaluate {e}")

    def pushable(self, e: S.Node | None, scope: Scope):
        """Of the conditions in a WHERE, those between stored FLOAT columns and literals: the bare column's name, and the condition on it.

        They follow from the WHERE, change no result, and are what can reach a scan.
        """
        if isinstance(e, S.Binary) and e.op == "and":
            yield from self.pushable(e.left, scope)
            yield from self.pushable(e.right, scope)
        sides = [e.left, e.right] if isinstance(e, S.Binary) and e.op in E._COMPARE else [e.of, e.low, e.high] if isinstance(e, S.Between) and not e.negated else []
        fields = [scope.find(x) for x in sides if isinstance(x, S.Column)]
        values = [self.value(x, scope) for x in sides if not isinstance(x, S.Column)]
        if len(fields) == 1 and fields[0].raw and all(v.literal is not None and v.numeric for v in values):
            bare = [E.Value(F.col(fields[0].raw), "FLOAT") if isinstance(x, S.Column) else self.value(x, scope) for x in sides]
            yield fields[0].raw, (E.compare(e.op, *bare) if isinstance(e, S.Binary) else E.between(*bare, False)).col

    # aggregation

    def aggregate(self, a: S.Aggregate, scope: Scope, inputs: dict[str, Column], name: str, number: Column | None) -> E.Value:
        """The aggregate over ``inputs``, to which its own input is added under ``name``.

        A COUNT adds up the ``number`` of rows that a row stands for, if there is one.
        """
        if a.of is None:
            if a.name != "count":
                raise BindError(f"{a.name.upper()}(*) has no meaning")
            if number is not None:
                inputs[name] = number
                return E.rows(F.col(name))
            return E.Value(F.count(F.lit(1)), "INT", 0, E.HIGH)
        if any(isinstance(x, S.Aggregate) for x in S.walk(a.of)):
            raise BindError(f"nested aggregate: {a}")
        v = E.plain(self.value(a.of, scope))
        if v.kind not in ("INT", "FLOAT", "DECIMAL", "NULL") and a.name in ("sum", "avg"):
            raise BindError(f"{a.name.upper()} of a {v.kind.lower()}")
        if v.kind == "OTHER" and a.name != "count":
            raise BindError(f"{a.name.upper()} of kind OTHER")
        if v.kind == "NULL" and a.name in ("sum", "avg"):
            v = E.Value(v.col.cast("bigint"), "INT", 0, 0)
        inputs[name] = E.double(v) if a.name == "avg" else v.col
        ref = F.col(name)
        if a.name == "count" and number is not None and not a.distinct:
            inputs[name] = F.when(v.col.isNotNull(), number)
            return E.rows(ref)
        if a.name == "count":
            return E.Value(F.count_distinct(ref) if a.distinct else F.count(ref), "INT", 0, E.HIGH)
        if a.name in ("min", "max"):
            return E.Value((F.min if a.name == "min" else F.max)(ref), v.kind, v.low, v.high)
        total = F.expr(f"{a.name}({'DISTINCT ' if a.distinct else ''}{name})")
        if a.name == "avg" or v.kind == "FLOAT":
            return E.Value(E.no_nan(total), "FLOAT")
        if v.kind == "DECIMAL":
            return E.Value(total, "DECIMAL")
        if not a.distinct:
            return E.total(ref, v.low, v.high)
        inputs[name] = v.col.cast("decimal(28,0)")
        return E.fitted(total)

    def grouped(self, s: S.Select, frame: DataFrame, scope: Scope, items: list[S.Item], row: Column | None, number: Column | None) -> tuple[DataFrame, dict[S.Node, E.Value], str | None]:
        wanted = [i.expr for i in items] + ([s.having] if s.having is not None else [])
        aggregates = list(dict.fromkeys(x for e in wanted for x in S.walk(e) if isinstance(x, S.Aggregate)))
        keys = [scope.find(c) for c in s.group]
        bare = list(dict.fromkeys(x for e in wanted for x in self.outside(e) if isinstance(x, S.Column) and scope.find(x) not in keys))
        inputs: dict[str, Column] = {}
        made, known, columns = {}, {}, []
        for k, a in enumerate(aggregates):
            made[a] = self.aggregate(a, scope, inputs, f"in{k}", number)
            columns.append(made[a].col.alias(f"agg{k}"))
        picked = [scope.find(c) for c in bare]
        if picked:
            columns.append(F.min_by(F.struct(*(F.col(f.physical) for f in picked)), F.col("row_id")).alias("first"))
        if row is not None:
            columns.append(F.min("row_id").alias("first_row"))
        keep = list(dict.fromkeys([f.physical for f in keys] + [f.physical for f in picked]))
        frame = frame.select(*keep, *(c.alias(n) for n, c in inputs.items()), *([row.alias("row_id")] if row is not None else []))
        if keys:
            physical = list(dict.fromkeys(f.physical for f in keys))
            out = frame.groupBy(*physical).agg(*(columns or [F.count(F.lit(1)).alias("n_rows")]))
        else:
            out = frame.agg(*columns)
        for k, a in enumerate(aggregates):
            known[a] = replace(made[a], col=F.col(f"agg{k}"))
        for c, f in zip(bare, picked, strict=True):
            known[c] = replace(f.value, col=F.col(f"first.{f.physical}"))
        return out, known, "first_row" if row is not None else None

    def outside(self, e: S.Node):
        """Nodes that are not inside an aggregate."""
        yield e
        if not isinstance(e, S.Aggregate):
            for c in S.children(e):
                yield from self.outside(c)

    # the statement

    def select(self, s: S.Select) -> tuple[DataFrame, list[Output]]:
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 20_000))
        try:
            return self._select(s)
        finally:
            sys.setrecursionlimit(before)

    def _select(self, s: S.Select) -> tuple[DataFrame, list[Output]]:
        has_aggregates = any(isinstance(x, S.Aggregate) for i in s.items if i.expr for x in S.walk(i.expr))
        grouping = bool(s.group) or has_aggregates
        # Rows come in input order.  A limit on one table alone takes the first partitions' rows and reads no more.
        unsorted_limit = s.limit is not None and not s.order and bool(grouping or s.joins or s.distinct)
        qualifiers = [s.table.qualifier, *(j.table.qualifier for j in s.joins)]
        may_be_bare = grouping and (any(i.expr is None for i in s.items) or any(isinstance(x, S.Column) and (x not in s.group) for i in s.items if i.expr for x in self.outside(i.expr)) or s.having is not None and any(isinstance(x, S.Column) and x not in s.group for x in self.outside(s.having)))
        need_rows = unsorted_limit or may_be_bare
        frame, fields, row = self.table(s.table, need_rows)
        rows = [row]
        if len(set(qualifiers)) < len(qualifiers):
            raise BindError(f"ambiguous table: {next(q for q in qualifiers if qualifiers.count(q) > 1)}")
        used, number = None, None
        for j in s.joins:
            right, more, row = self.table(j.table, need_rows)
            used = self.counted(s, fields, more) if grouping and not need_rows else None
            if used is not None:
                both = Scope(fields + more)
                frame, right = self.merged(frame, fields, used, s.where, both, "n_left"), self.merged(right, more, used, s.where, both, "n_right")
                number = E.product(F.col("n_left"), F.col("n_right"))
            fields = fields + more
            frame = self.join(frame, right, j, Scope(fields))
            rows.append(row)
        scope, place = Scope(fields), F.struct(*rows) if need_rows else None
        if s.where is not None:
            frame = frame.filter(E.truth(self.value(s.where, scope)))
            for _, bare in self.pushable(s.where, scope) if used is None else ():
                frame = frame.filter(bare)
        for c in s.group:
            scope.find(c)
        items: list[S.Item] = []
        for i in s.items:
            items += [i] if i.expr is not None else [S.Item(S.Column(f.qualifier, f.name), None) for f in fields]
        starred = {id(x) for i, x in zip([i for i in s.items for _ in (range(len(fields)) if i.expr is None else (0,))], items, strict=True) if i.expr is None}
        known, order_row = None, None
        if grouping:
            frame, known, order_row = self.grouped(s, frame, scope, items, place, number)
            if s.having is not None:
                frame = frame.filter(E.truth(self.value(s.having, scope, known)))
            if not unsorted_limit:
                order_row = None
        elif unsorted_limit:
            frame, order_row = frame.withColumn("first_row", place), "first_row"
        outputs = []
        for i in items:
            v = self.value(i.expr, scope, known)
            v = E.plain(v)
            qualifier = i.expr.table if isinstance(i.expr, S.Column) and not i.alias and id(i) not in starred else None
            if id(i) in starred:
                qualifier = i.expr.table
            outputs.append(Output(i.alias or self.name_of(i.expr), qualifier, v))
        names = [f"o{k}" for k in range(len(outputs))]
        columns = [(o.value.col if o.value.kind != "NULL" else F.lit(None).cast("string")).alias(n) for o, n in zip(outputs, names, strict=True)]
        order = [self.sort_key(k, outputs, scope) for k in s.order]
        frame = frame.select(*columns, *([F.col(order_row).alias("first_row")] if order_row else []))
        if s.distinct:
            frame = frame.groupBy(*names).agg(F.min("first_row").alias("first_row")) if order_row else frame.distinct()
        if order:
            frame = frame.orderBy(*(F.col(f"o{k}").desc_nulls_last() if desc else F.col(f"o{k}").asc_nulls_first() for k, desc in order))
        elif order_row:
            frame = frame.orderBy("first_row")
        if s.limit is not None:
            frame = frame.limit(s.limit)
        if order_row:
            frame = frame.drop("first_row")
        return frame.toDF(*(o.name for o in outputs)), outputs

    @staticmethod
    def name_of(e: S.Node) -> str:
        if isinstance(e, S.Column):
            return e.name
        if isinstance(e, S.Aggregate):
            return e.name.upper()
        return e.name if isinstance(e, S.Call) else "expr"

    def sort_key(self, k: S.SortKey, outputs: list[Output], scope: Scope) -> tuple[int, bool]:
        if isinstance(k.key, int):
            if not 1 <= k.key <= len(outputs):
                raise BindError(f"ORDER BY position {k.key} is out of range")
            return k.key - 1, k.descending
        hits = [i for i, o in enumerate(outputs) if o.name == k.key.name and k.key.table in (None, o.qualifier)]
        if len(hits) > 1:
            raise BindError(f"ambiguous column: {k.key}")
        if not hits:
            scope.find(k.key)
            raise BindError(f"ORDER BY {k.key}: not a selected column")
        return hits[0], k.descending
