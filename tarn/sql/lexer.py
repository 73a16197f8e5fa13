"""SQL text -> tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import ParseError

# The dialect's reserved words.
KEYWORDS = frozenset("select from where join on left inner group by order asc desc having limit and or not as null count sum avg min max distinct like in between is".split())

_TOKEN = re.compile(
    r"(?P<space>[ \t\n\v\f\r]+)|(?P<float>[0-9]+\.[0-9]*)|(?P<int>[0-9]+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?P<string>'(?:[^']|'')*')|(?P<open>'.*)|(?P<op><=|>=|<>|!=|[=<>+\-*/(),.])",
    re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # keyword (lower case), operator, or one of: int float string name end
    text: str


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected character {sql[at]!r} at token {len(out)}")
        kind, text, at = m.lastgroup, m[0], m.end()
        if kind == "open":
            raise ParseError(f"unterminated string literal at token {len(out)}")
        if kind == "word":
            out.append(Token(text.lower() if text.lower() in KEYWORDS else "name", text))
        elif kind == "op":
            out.append(Token("<>" if text == "!=" else text, text))
        elif kind == "string":
            out.append(Token("string", text[1:-1].replace("''", "'")))
        elif kind != "space":
            out.append(Token(kind, text))
    return [*out, Token("end", "")]
