"""The line shell: ``python -m tarn.repl``."""

from __future__ import annotations

import sys

from .session import Session
from .sql.errors import BindError, DialectError, ParseError

HELP = """.load FILE NAME            read a CSV file (or a .parquet path) as a table
.tables                    names and row counts
.schema NAME               columns and kinds
.dump NAME                 print a table
.ast SQL                   print the syntax tree
.plan SQL                  print the plan
.join auto|nested|hash     prefer a join algorithm
.index TABLE COLUMN [hash|sorted]
.autoindex on|off
.timer on|off
.help  .quit  .exit
Any other line is a SELECT statement."""


class Done(Exception):
    pass


def command(session: Session, line: str) -> str:
    """Run one line and return what it prints."""
    line = line.strip()
    try:
        if not line.startswith("."):
            if not line.rstrip(";").strip():
                return ""
            if session.timer:
                out, ms = session.timed(line)
                return f"{out}\n{ms:.1f} ms"
            return session.show(line)
        name, _, rest = line.partition(" ")
        args = rest.split()
        match name, args:
            case (".quit" | ".exit"), _:
                raise Done
            case ".help", _:
                return HELP
            case ".load", [path, table]:
                if path.endswith(".parquet"):
                    session.load_parquet(path, table)
                    return f"loaded {table}"
                n = session.load_csv(path, table)
                return f"loaded {n} row{'' if n == 1 else 's'} into {table}"
            case ".tables", _:
                return "\n".join(f"{n} ({r} rows)" for n, r in session.tables())
            case ".schema", [table]:
                return "\n".join(f"{c} {k}" for c, k in session.schema(table))
            case ".dump", [table]:
                return session.dump(table)
            case ".ast", _ if rest:
                return session.ast(rest)
            case ".plan", _ if rest:
                return session.plan(rest)
            case ".join", [mode]:
                session.set_join_mode(mode)
                return f"join mode: {mode}"
            case ".index", [table, column, *kind] if len(kind) < 2:
                session.index(table, column, *kind)
                return f"index on {table}.{column}"
            case (".autoindex" | ".timer"), [("on" | "off") as state]:
                setattr(session, "timer" if name == ".timer" else "auto_index", state == "on")
                return f"{name[1:]} {state}"
        return f"unknown command or wrong arguments: {line} (.help lists commands)"
    except ParseError as e:
        return f"parse error: {e}"
    except BindError as e:
        return f"bind error: {e}"
    except DialectError as e:
        return f"error: {e}"


def main() -> None:
    from pyspark.sql import SparkSession

    session = Session(SparkSession.builder.appName("tarn").getOrCreate())
    for line in sys.stdin:
        try:
            if out := command(session, line):
                print(out, flush=True)
        except Done:
            return


if __name__ == "__main__":
    main()
