"""Grammar membership: a GBNF grammar without recursion, compiled to one regular expression.

The grammar's text is a parameter.  A text that does not belong gives the line and column up to which some continuation
would still have belonged.
"""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:#[^\n]*\n\s*)*(?:(?P<rule>[A-Za-z][\w-]*)\s*::=|(?P<name>[A-Za-z][\w-]*)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<set>\[(?:[^\]\\]|\\.)*\])|(?P<mark>[()|?*+]|\{\d+(?:,\d*)?\}))')


def rules(source: str) -> dict[str, list[tuple[str, str]]]:
    """Tokens of each rule."""
    out: dict[str, list[tuple[str, str]]] = {}
    at, body = 0, None
    source = source.rstrip() + "\n"
    while (m := _TOKEN.match(source, at)) and m.lastgroup:
        at = m.end()
        if m.lastgroup == "rule":
            body = out.setdefault(m["rule"], [])
        elif body is None:
            raise ValueError("The grammar does not start with a rule")
        else:
            body.append((m.lastgroup, m[m.lastgroup]))
    rest = re.sub(r"#[^\n]*", "", source[at:]).strip()
    if rest:
        raise ValueError(f"Cannot read the grammar at {rest[:40]!r}")
    return out


def to_pattern(source: str, root: str = "root") -> str:
    """A regular expression for ``root``; rules that use themselves are an error."""
    known = rules(source)
    done: dict[str, str] = {}

    def build(name: str, above: tuple[str, ...]) -> str:
        if name not in known:
            raise ValueError(f"Unknown rule {name!r}")
        if name in above:
            raise ValueError(f"Rule {name!r} uses itself")
        if name not in done:
            parts = []
            for kind, text in known[name]:
                if kind == "name":
                    parts.append(f"(?:{build(text, (*above, name))})")
                elif kind == "string":
                    parts.append(f"(?:{re.escape(re.sub(r'\\(.)', lambda m: {'n': chr(10), 't': chr(9), 'r': chr(13)}.get(m[1], m[1]), text[1:-1]))})")
                else:
                    parts.append("(?:" if text == "(" else text)
            done[name] = "".join(parts)
        return done[name]

    return build(root, ())


def check(pattern: regex.Pattern, text: str) -> tuple[bool, int | None, int | None]:
    """(belongs, line, column) of the first character that cannot be; the end of the text where it stops too soon."""
    if pattern.fullmatch(text):
        return True, None, None
    low, high = 0, len(text)  # the longest front that could go on
    while low < high:
        mid = (low + high + 1) // 2
        if pattern.fullmatch(text[:mid], partial=True):
            low = mid
        else:
            high = mid - 1
    front = text[:low]
    return False, front.count("\n") + 1, low - (front.rfind("\n") + 1) + 1


def grammar_column(text: Column | str, source: str, root: str = "root") -> Column:
    """STRUCT of belongs, line and column."""
    made = to_pattern(source, root)

    @F.pandas_udf("belongs boolean, line int, col int")
    def run(texts: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(made)
        return pd.DataFrame([check(pattern, t if isinstance(t, str) else "") for t in texts], columns=["belongs", "line", "col"]).astype({"line": "Int32", "col": "Int32"})

    return run(text)
