"""Filter expressions of a vector store as Spark predicates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(
    r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<key>[A-Za-z_]\w*\s*\[\s*(?P<quote>["'])(?P<name>\w+)(?P=quote)\s*\])
    |(?P<word>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)
    |(?P<sign>==|!=|<>|<=|>=|&&|\|\||[<>=!+\-*/%()\[\],])|(?P<end>$))""",
    re.VERBOSE,
)
_SIGNS = {"==": "=", "&&": "AND", "||": "OR", "[": "(", "]": ")", "!": "NOT"}
_WORDS = {"and", "or", "not", "in", "like", "is"}
_VALUES = {"true", "false", "null"}


class FilterError(ValueError):
    """An expression that is not a filter, and where."""


def to_sql(expr: str) -> str:
    """`==`, `&&`, `||`, `!`, `in [...]` and `field["key"]` in Spark's words; text literals stay as they are.

    Only fields, literals, comparisons, arithmetic, lists and and, or, not, in, like, is are let
    through: two operands in a row, a call, or any other sign is a FilterError, so no query can stand
    in a filter.
    """
    out: list[str] = []
    at, operand, opened = 0, False, []
    while at < len(expr.rstrip()):
        m = _PART.match(expr, at)
        if m is None:
            at = len(expr) - len(expr[at:].lstrip())
            raise FilterError(f"not a filter at {at}: {expr[at : at + 20]!r}")
        start, at = m.end() - len(m[0].lstrip()), m.end()
        word = (m["word"] or "").lower()
        if m["text"] or m["number"] or m["key"] or (word and word not in _WORDS):
            if operand:
                raise FilterError(f"an operator is missing at {start}: {expr[start : start + 20]!r}")
            operand = True
            if m["text"]:
                body = m["text"][1:-1].replace("\\'", "'").replace('\\"', '"')
                out.append("'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'")
            elif m["key"]:
                out.append(f"`{m['key'].partition('[')[0].strip()}`.`{m['name']}`")
            else:
                out.append(m["number"] or (word if word in _VALUES else ".".join(f"`{x}`" for x in m["word"].split("."))))
            continue
        sign = m["sign"] or word
        if sign in ("(", "["):
            if operand:
                raise FilterError(f"a call at {start}: {expr[start : start + 20]!r}")
            opened.append(sign)
        elif sign in (")", "]"):
            if not opened or {"(": ")", "[": "]"}[opened.pop()] != sign:
                raise FilterError(f"nothing to close at {start}")
        operand = sign in (")", "]")
        out.append(_SIGNS.get(sign, sign.upper()))
    if opened:
        raise FilterError(f"{opened[-1]!r} is never closed")
    return " ".join(out)


def matching(rows: DataFrame, expr: str | None) -> DataFrame:
    return rows if expr is None or not expr.strip() else rows.filter(F.expr(to_sql(expr)))
