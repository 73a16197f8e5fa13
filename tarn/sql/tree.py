"""The syntax tree.  Frozen, so equal expressions compare equal."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    pass


@dataclass(frozen=True)
class Column(Node):
    table: str | None
    name: str

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Literal(Node):
    value: int | float | str | None

    def __str__(self) -> str:
        if self.value is None:
            return "NULL"
        if isinstance(self.value, str):
            return f"'{self.value}'"
        return f"{self.value:g}" if isinstance(self.value, float) else str(self.value)


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"({self.left} {self.op.upper()} {self.right})"


@dataclass(frozen=True)
class Unary(Node):
    op: str
    of: Node

    def __str__(self) -> str:
        return f"{'NOT ' if self.op == 'not' else '-'}{self.of}"


@dataclass(frozen=True)
class Aggregate(Node):
    name: str
    of: Node | None  # None: *
    distinct: bool = False

    def __str__(self) -> str:
        return f"{self.name.upper()}({'*' if self.of is None else ('DISTINCT ' if self.distinct else '') + str(self.of)})"


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class IsNull(Node):
    of: Node
    negated: bool

    def __str__(self) -> str:
        return f"{self.of} IS {'NOT ' if self.negated else ''}NULL"


@dataclass(frozen=True)
class In(Node):
    of: Node
    items: tuple[Node, ...]
    negated: bool

    def __str__(self) -> str:
        return f"({self.of} {'NOT ' if self.negated else ''}IN ({', '.join(map(str, self.items))}))"


@dataclass(frozen=True)
class Between(Node):
    of: Node
    low: Node
    high: Node
    negated: bool

    def __str__(self) -> str:
        return f"({self.of} {'NOT ' if self.negated else ''}BETWEEN {self.low} AND {self.high})"


@dataclass(frozen=True)
class Like(Node):
    of: Node
    pattern: Node
    negated: bool

    def __str__(self) -> str:
        return f"({self.of} {'NOT ' if self.negated else ''}LIKE {self.pattern})"


@dataclass(frozen=True)
class Item:
    expr: Node | None  # None: *
    alias: str | None

    def __str__(self) -> str:
        return ("*" if self.expr is None else str(self.expr)) + (f" AS {self.alias}" if self.alias else "")


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None

    @property
    def qualifier(self) -> str:
        return self.alias or self.name

    def __str__(self) -> str:
        return f"{self.name} {self.alias}" if self.alias else self.name


@dataclass(frozen=True)
class Join:
    table: Table
    left: bool
    on: Node


@dataclass(frozen=True)
class SortKey:
    key: int | Column  # a position from 1, or a name
    descending: bool


@dataclass(frozen=True)
class Select:
    distinct: bool
    items: tuple[Item, ...]
    table: Table
    joins: tuple[Join, ...]
    where: Node | None
    group: tuple[Column, ...]
    having: Node | None
    order: tuple[SortKey, ...]
    limit: int | None

    def __str__(self) -> str:
        lines = [f"SELECT {'DISTINCT ' if self.distinct else ''}{', '.join(map(str, self.items))}", f"FROM {self.table}"]
        lines += [f"{'LEFT' if j.left else 'INNER'} JOIN {j.table} ON {j.on}" for j in self.joins]
        for word, part in (("WHERE", self.where), ("GROUP BY", ", ".join(map(str, self.group))), ("HAVING", self.having), ("ORDER BY", ", ".join(f"{k.key} {'DESC' if k.descending else 'ASC'}" for k in self.order)), ("LIMIT", self.limit)):
            if part not in (None, ""):
                lines.append(f"{word} {part}")
        return "\n  ".join(lines)


def children(node: Node) -> list[Node]:
    out: list[Node] = []
    for value in vars(node).values():
        out += [value] if isinstance(value, Node) else [v for v in value if isinstance(v, Node)] if isinstance(value, tuple) else []
    return out


def walk(node: Node):
    yield node
    for c in children(node):
        yield from walk(c)
