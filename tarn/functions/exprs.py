"""The dialect's semantics as Spark columns.

A ``Value`` is a column with a static kind: INT, FLOAT, STRING, NULL or BOOL (a predicate; an INT 1/0 to the
outside); from typed sources also DECIMAL, DATE, TIMESTAMP, TIMESTAMP_NTZ and OTHER, which only passes through.

Kinds never depend on data.  INT values carry the range that their types and literals allow: an operation that
cannot leave 64 bits is plain, one that must is FLOAT.  One that may is a checked INT, and a row that leaves
64 bits is an error (``OVERFLOW``); in the wide mode it is FLOAT in all rows.  Predicates over equal kinds stay
bare, so Catalyst can push them down and find equi-join keys.
"""

from __future__ import annotations

import re
from contextvars import ContextVar
from dataclasses import dataclass
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sql.errors import BindError

LOW, HIGH = -(1 << 63), (1 << 63) - 1
TEMPORAL = ("DATE", "TIMESTAMP", "TIMESTAMP_NTZ")
OVERFLOW = "INT overflow: a result leaves 64 bits; overflow='float' computes it as FLOAT"
#: Whether INT operations that may leave 64 bits are FLOAT.
WIDE: ContextVar[bool] = ContextVar("wide", default=False)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str
    low: int = LOW
    high: int = HIGH
    literal: object = None  # Python value of a literal

    @property
    def numeric(self) -> bool:
        return self.kind in ("INT", "FLOAT", "BOOL", "DECIMAL")


def literal(value) -> Value:
    if value is None:
        return Value(F.lit(None).cast("string"), "NULL")
    if isinstance(value, str):
        return Value(F.lit(value), "STRING", literal=value)
    if isinstance(value, float):
        return Value(F.lit(value), "FLOAT", literal=value)
    return Value(F.lit(value).cast("bigint"), "INT", value, value, literal=value)


def predicate(col: Column) -> Value:
    return Value(col, "BOOL", 0, 1)


UNKNOWN = lambda: predicate(F.lit(None).cast("boolean"))


def plain(v: Value) -> Value:
    """A predicate as the INT that it is."""
    return Value(v.col.cast("int").cast("bigint"), "INT", 0, 1) if v.kind == "BOOL" else v


def double(v: Value) -> Column:
    return plain(v).col if v.kind == "FLOAT" else plain(v).col.cast("double")


def no_nan(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def overflow(present: Column) -> Column:
    """An error where ``present`` holds, else null."""
    return F.when(present, F.raise_error(F.lit(OVERFLOW)).cast("bigint"))


def known_kind(*values: Value) -> None:
    """Raise if a value has a kind that nothing computes with."""
    for v in values:
        if v.kind == "OTHER" or v.kind in TEMPORAL:
            raise BindError(f"no operation of this kind on {v.kind}")


def truth(v: Value) -> Column:
    """Three-valued truth: numbers by being nonzero, strings are false."""
    known_kind(v)
    if v.kind == "BOOL":
        return v.col
    if v.kind == "NULL":
        return F.lit(None).cast("boolean")
    if v.kind == "STRING":
        return F.when(v.col.isNotNull(), F.lit(False))
    return v.col != F.lit(0)


def logic(op: str, a: Value, b: Value) -> Value:
    return predicate(truth(a) & truth(b) if op == "and" else truth(a) | truth(b))


def negate(a: Value) -> Value:
    return predicate(~truth(a))


_COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def _moment(v: Value, kind: str) -> Value:
    """A string literal as a value of the temporal kind it is compared with."""
    try:
        at = datetime.fromisoformat(v.literal)
    except ValueError as e:
        raise BindError(f"not a {kind}: {v.literal!r}") from e
    if kind == "DATE" and at != datetime.combine(at.date(), datetime.min.time()):
        kind = "TIMESTAMP_NTZ"
    return Value(F.lit(date(at.year, at.month, at.day)) if kind == "DATE" else F.lit(v.literal).cast(kind.lower()), kind)


def matched(a: Value, b: Value) -> tuple[Column, Column] | None:
    """The two as columns to compare; None if they never compare (a string with a number, or a bare NULL)."""
    if "NULL" in (a.kind, b.kind):
        return None
    if "OTHER" in (a.kind, b.kind):
        raise BindError("values of kind OTHER cannot be compared")
    if a.kind in TEMPORAL or b.kind in TEMPORAL:
        if a.kind == "STRING" and a.literal is not None:
            a = _moment(a, b.kind)
        elif b.kind == "STRING" and b.literal is not None:
            b = _moment(b, a.kind)
        if a.kind not in TEMPORAL or b.kind not in TEMPORAL:
            raise BindError(f"{a.kind} cannot be compared with {b.kind}")
        return a.col, b.col
    return (plain(a).col, plain(b).col) if a.numeric and b.numeric or a.kind == b.kind == "STRING" else None


def compare(op: str, a: Value, b: Value) -> Value:
    """Unknown for a string against a number: nothing is converted."""
    pair = matched(a, b)
    return predicate(_COMPARE[op](*pair)) if pair else UNKNOWN()


def is_null(a: Value, negated: bool) -> Value:
    return predicate(a.col.isNotNull() if negated else a.col.isNull())


def between(a: Value, low: Value, high: Value, negated: bool) -> Value:
    """Unknown if either comparison is."""
    least, most = matched(a, low), matched(a, high)
    if not (least and most):
        return UNKNOWN()
    x, lo, hi = least[0], least[1], most[1]
    inside = x.between(lo, hi)
    if low.literal is None or high.literal is None:
        inside = F.when(x.isNotNull() & lo.isNotNull() & hi.isNotNull(), inside)
    return predicate(~inside if negated else inside)


def within(a: Value, items: list[Value], negated: bool) -> Value:
    """An item of another kind is no match; a null item makes a miss unknown."""
    if a.kind == "NULL":
        return UNKNOWN()
    pairs = [matched(a, i) for i in items]
    x, same, null = plain(a).col, [p[1] for p in pairs if p], any(i.kind == "NULL" for i in items)
    found = x.isin(*same) if same else F.when(x.isNotNull(), F.lit(False))
    if null:
        found = F.when(x.isNotNull(), F.when(found, F.lit(True)))
    elif len(same) < len(items):  # a null among items of another kind still makes a miss unknown
        for i, p in zip(items, pairs, strict=True):
            if p is None and i.literal is None:
                found = F.when(found, F.lit(True)).when(i.col.isNotNull(), found)
    return predicate(~found if negated else found)


def byte_view(col: Column) -> Column:
    """A string with a character per byte."""
    return F.decode(F.encode(col, "UTF-8"), "ISO-8859-1")


def like_regex(pattern: str) -> str:
    """% any run, _ any byte, nothing is escaped; each run takes the first place that fits and stays there."""
    quoted = lambda s: "".join("." if c == "_" else re.escape(c) for c in s.encode().decode("latin-1"))
    first, *rest = re.split("%+", pattern)
    if not rest:
        return rf"(?is)\A{quoted(first)}\z"
    middle = "".join(f"(?>.*?{quoted(s)})" for s in rest[:-1])
    return rf"(?is)\A{quoted(first)}{middle}.*{quoted(rest[-1])}\z"


def like(a: Value, pattern: Value, negated: bool) -> Value:
    known_kind(a, pattern)
    if a.kind != "STRING" or pattern.kind != "STRING":
        return UNKNOWN()
    if pattern.literal is not None:
        hit = byte_view(a.col).rlike(like_regex(pattern.literal))
    else:
        body = F.regexp_replace(byte_view(pattern.col), r"([^A-Za-z0-9%_\x80-\xff])", r"\\$1")
        parts = F.split(F.replace(body, F.lit("_"), F.lit(".")), "%+", -1)  # as like_regex does it
        middle = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: F.concat(F.lit("(?>.*?"), s, F.lit(")")))
        rest = F.when(F.size(parts) > 1, F.concat(F.array_join(middle, ""), F.lit(".*"), F.element_at(parts, -1))).otherwise("")
        hit = F.regexp_like(byte_view(a.col), F.concat(F.lit(r"(?is)\A"), F.get(parts, F.lit(0)), rest, F.lit(r"\z")))
    return predicate(~hit if negated else hit)


def _ranged(low: int, high: int, exact: Column, attempt: Column, present: Column, wide: Column) -> Value:
    """bigint if the range fits, double if it lies outside or in the wide mode, else a checked bigint.

    ``attempt`` is the result, null where it leaves 64 bits though the operands are ``present``.
    """
    if LOW <= low and high <= HIGH:
        return Value(exact, "INT", low, high)
    if low > HIGH or high < LOW or WIDE.get():
        return Value(wide, "FLOAT")
    return Value(F.coalesce(attempt, overflow(present)), "INT", max(low, LOW), min(high, HIGH))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    known_kind(a, b)
    if not (a.numeric and b.numeric):
        return Value(F.lit(None).cast("double"), "FLOAT") if "FLOAT" in (a.kind, b.kind) else Value(F.lit(None).cast("bigint"), "INT", 0, 0)
    if {"FLOAT", "DECIMAL"} & {a.kind, b.kind}:
        x, y = double(a), double(b)
        if op == "/":
            return Value(no_nan(F.when(y != 0, F.try_divide(x, y))), "FLOAT")
        return Value(no_nan(x + y if op == "+" else x - y if op == "-" else x * y), "FLOAT")
    a, b = plain(a), plain(b)
    x, y = a.col, b.col
    present, dx, dy = x.isNotNull() & y.isNotNull(), x.cast("double"), y.cast("double")
    if op == "/":
        most = max(abs(a.low), abs(a.high))
        quotient = F.call_function("div", x, F.when(y != 0, y))
        if not (b.low <= -1 <= b.high and a.low == LOW):
            return Value(quotient, "INT", max(LOW, -most), min(HIGH, most))
        edge = (x == LOW) & (y == -1)  # only the least integer over -1 leaves the range
        exact = F.when((y != 0) & ~edge, quotient)
        if WIDE.get() or a.high == LOW and b.low == b.high:
            return Value(F.coalesce(F.when(edge, F.lit(float(1 << 63))), exact.cast("double")), "FLOAT")
        return Value(F.coalesce(exact, overflow(edge)), "INT")
    if op == "*":
        ends = [p * q for p in (a.low, a.high) for q in (b.low, b.high)]
        tried = F.try_multiply(x, y)
        return _ranged(min(ends), max(ends), x * y, tried, present, F.coalesce(tried.cast("double"), dx * dy))
    if op == "+":
        tried = F.try_add(x, y)
        return _ranged(a.low + b.low, a.high + b.high, x + y, tried, present, F.coalesce(tried.cast("double"), dx + dy))
    tried = F.try_subtract(x, y)
    return _ranged(a.low - b.high, a.high - b.low, x - y, tried, present, F.coalesce(tried.cast("double"), dx - dy))


def minus(a: Value) -> Value:
    known_kind(a)
    if a.kind in ("FLOAT", "DECIMAL"):
        return Value(-a.col, a.kind, literal=None if a.literal is None else -a.literal)
    if a.kind in ("STRING", "NULL"):
        return Value(F.lit(None).cast("bigint"), "INT", 0, 0)
    a = plain(a)
    if a.literal is not None and a.literal != LOW:
        return literal(-a.literal)
    return _ranged(-a.high, -a.low, -a.col, F.try_subtract(F.lit(0).cast("bigint"), a.col), a.col.isNotNull(), -a.col.cast("double"))


def absolute(a: Value) -> Value:
    known_kind(a)
    if a.kind in ("FLOAT", "DECIMAL"):
        return Value(F.abs(a.col), a.kind)
    if a.kind in ("STRING", "NULL"):
        return Value(F.lit(None).cast("bigint"), "INT", 0, 0)
    a = plain(a)
    low = 0 if a.low <= 0 <= a.high else min(abs(a.low), abs(a.high))
    return _ranged(low, max(abs(a.low), abs(a.high)), F.abs(a.col), F.when(a.col != LOW, F.abs(a.col)), a.col.isNotNull(), F.abs(a.col.cast("double")))


def total(ref: Column, low: int, high: int) -> Value:
    """The exact sum of INT inputs with values from low to high.

    Values are summed in parts of 21 bits, each a bigint that holds 2^42 rows; the parts meet once per group, so
    only a total that leaves 64 bits itself is an overflow.
    """
    bits = max(high.bit_length(), (-1 - low).bit_length())
    parts, shift = [], 0
    while bits - shift > 21:
        parts.append((shift, F.sum(F.shiftright(ref, shift).bitwiseAND(F.lit((1 << 21) - 1)))))
        shift += 21
    parts.append((shift, F.sum(F.shiftright(ref, shift))))
    if len(parts) == 1:
        return Value(parts[0][1], "INT")
    exact = None
    for by, part in reversed(parts):
        scaled = part.cast("decimal(20,0)") * F.lit(1 << by).cast("decimal(14,0)")
        exact = scaled if exact is None else exact + scaled
    return fitted(exact)


def fitted(exact: Column) -> Value:
    """An exact decimal total as INT, or FLOAT in the wide mode."""
    if WIDE.get():
        return Value(exact.cast("double"), "FLOAT")
    inside = exact.between(F.lit(LOW), F.lit(HIGH))
    return Value(F.when(inside, exact.cast("bigint")).otherwise(overflow(exact.isNotNull())), "INT")


def product(a: Column, b: Column) -> Column:
    """The product of two numbers of rows."""
    return F.coalesce(F.try_multiply(a, b), overflow(a.isNotNull() & b.isNotNull()))


def rows(number: Column) -> Value:
    """The count of rows behind the ``number`` that each row stands for: an INT in any mode, 0 without rows."""
    before = WIDE.set(False)
    try:
        count = total(number, 0, HIGH)
    finally:
        WIDE.reset(before)
    return Value(F.coalesce(count.col, F.lit(0).cast("bigint")), "INT", 0, HIGH)


def round_exact(d: Column, n: int) -> Column:
    """Half away from zero on the exact binary value, for 0 <= n <= 14.

    The fraction is scaled with an error-free product, so a tie is a tie of the stored value.
    """
    size = F.abs(d)
    if n == 0:
        out = F.floor(size + 0.5).cast("double") * F.signum(d) + 0.0
        return F.when(size >= float(1 << 52), d).otherwise(out)
    scale, split = float(10 ** (n + 1)), 134217729.0
    x = size - F.floor(size).cast("double")
    p = x * scale
    unit = F.floor(p / 10.0)
    t = x * split
    xh = t - (t - x)
    xl = x - xh
    sh = scale * split - (scale * split - scale)
    sl = scale - sh
    error = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    over = lambda k: (p - k.cast("double") * 10.0 - 5.0) + error >= 0
    m = F.when(~over(unit - 1), unit - 1).when(~over(unit), unit).when(~over(unit + 1), unit + 1).otherwise(unit + 2)
    whole = F.floor(size).cast("decimal(20,0)")
    part = (m.cast("decimal(18,0)") * F.lit(f"1e-{n}").cast(f"decimal(18,{n})")).cast(f"decimal(20,{n})")
    out = (whole + part).cast("double") * F.signum(d) + 0.0
    return F.when(size >= float(1 << 53), d).otherwise(out)


def _round_any(d: Column, n: Column) -> Column:
    """Any number of digits, by decimal arithmetic in a pandas UDF: only for n over 14 or from a column."""
    @F.pandas_udf("double")
    def run(values: pd.Series, digits: pd.Series) -> pd.Series:
        import math
        from decimal import ROUND_HALF_UP, Context, Decimal

        exact = Context(prec=1200)
        out = []
        for v, k in zip(values, digits, strict=True):
            if v is None or k is None or pd.isna(v) or pd.isna(k):
                out.append(None)
            elif math.isinf(v):
                out.append(v)
            else:
                k = min(30, max(0, int(k)))
                out.append(float(Decimal(v).quantize(Decimal(1).scaleb(-k), rounding=ROUND_HALF_UP, context=exact)) + 0.0)
        return pd.Series(out, dtype="float64").astype(object).where(lambda s: s.notna(), None)

    return run(d, n)


def round_value(a: Value, n: Value | None) -> Value:
    known_kind(a, *([n] if n is not None else []))
    if not a.numeric or n is not None and n.kind == "NULL":
        return Value(F.lit(None).cast("double"), "FLOAT")
    d = double(a)
    if n is None or n.kind == "STRING":
        digits = F.lit(0) if n is None else n.col
        return Value(F.when(digits.isNotNull(), round_exact(d, 0)), "FLOAT")
    if n.literal is not None:
        k = min(30, max(0, int(n.literal)))
        if a.kind not in ("FLOAT", "DECIMAL"):
            return Value(d, "FLOAT")
        return Value(round_exact(d, k) if k <= 14 else _round_any(d, F.lit(float(k))), "FLOAT")
    return Value(_round_any(d, double(n)), "FLOAT")


def _g_text(d: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:g}")

    return run(d)


def length(a: Value) -> Value:
    """Bytes; numbers by their printed form."""
    if a.kind == "NULL":
        return Value(F.lit(None).cast("bigint"), "INT", 0, 0)
    text = a.col if a.kind in ("STRING", "OTHER") else _g_text(a.col) if a.kind == "FLOAT" else plain(a).col.cast("string")
    if a.kind == "OTHER":
        raise BindError("LENGTH of kind OTHER")
    return Value(F.octet_length(text).cast("bigint"), "INT", 0, 1 << 31)


def coalesce(args: list[Value]) -> Value:
    args = [plain(a) for a in args]
    kinds = {a.kind for a in args if a.kind != "NULL"}
    if not kinds:
        return literal(None)
    if "STRING" in kinds and len(kinds) > 1:
        raise BindError("COALESCE mixes strings and numbers")
    args = [a for a in args if a.kind != "NULL"]
    if kinds == {"INT"}:
        return Value(F.coalesce(*(a.col for a in args)), "INT", min(a.low for a in args), max(a.high for a in args))
    if kinds & {"OTHER", *TEMPORAL} and len(kinds) > 1:
        raise BindError(f"COALESCE mixes {', '.join(sorted(kinds))}")
    if len(kinds) == 1 and kinds != {"FLOAT"}:
        return Value(F.coalesce(*(a.col for a in args)), kinds.pop())
    return Value(F.coalesce(*(double(a) for a in args)), "FLOAT")


def _fold(a: Value, source: str, target: str) -> Value:
    return Value(F.translate(a.col, source, target), "STRING") if a.kind == "STRING" else plain(a)


#: name -> (least arguments, most, function)
FUNCTIONS = {
    "upper": (1, 1, lambda a: _fold(a, LOWER, UPPER)),
    "lower": (1, 1, lambda a: _fold(a, UPPER, LOWER)),
    "length": (1, 1, length),
    "abs": (1, 1, absolute),
    "round": (1, 2, lambda a, n=None: round_value(a, n)),
    "coalesce": (0, 1 << 30, lambda *a: coalesce(list(a))),
    "trim": (1, 1, lambda a: Value(F.trim(a.col), "STRING") if a.kind == "STRING" else plain(a)),
}


def call(name: str, args: list[Value]) -> Value:
    if name.lower() not in FUNCTIONS:
        raise BindError(f"no such function: {name}")
    least, most, run = FUNCTIONS[name.lower()]
    if not least <= len(args) <= most:
        raise BindError(f"wrong number of arguments to {name}")
    return run(*args)
