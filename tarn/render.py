"""Result grids."""

from __future__ import annotations

from collections.abc import Sequence

CELL = 511  # bytes shown of a cell


def cell(value) -> str:
    if value is None:
        return "NULL"
    text = f"{value:g}" if isinstance(value, float) else str(value)
    return text.encode()[:CELL].decode(errors="ignore")


def grid(names: Sequence[str], kinds: Sequence[str], rows: Sequence[Sequence]) -> str:
    cells = [[cell(v) for v in r] for r in rows]
    widths = [max(len(x) for x in column) for column in zip(names, kinds, *cells, strict=True)]
    line = lambda parts: "".join(f"{p:<{w}}  " for p, w in zip(parts, widths, strict=True))
    body = [line(names), line(kinds), line(["-" * w for w in widths]), *map(line, cells)]
    return "\n".join([*body, f"({len(rows)} row{'' if len(rows) == 1 else 's'})"])
