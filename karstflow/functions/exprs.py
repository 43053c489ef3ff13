"""Predicates, cursors and orders as Columns, with SQL three-valued logic."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.catalog import RequestError

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMERIC = re.compile(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")


def coerce(value: Any, kind: str) -> tuple[Any, bool]:
    """The literal in the column's kind, and whether it fits there."""
    if kind == "number":
        if isinstance(value, bool):
            return int(value), True
        if isinstance(value, str):
            return (float(value), True) if NUMERIC.match(value) else (value, False)
        return value, True
    if kind == "boolean":
        if isinstance(value, bool):
            return value, True
        if isinstance(value, str):
            return (float(value), True) if NUMERIC.match(value) else (value, False)
        return value, True
    if isinstance(value, bool):
        return str(int(value)), True
    if isinstance(value, float) and value.is_integer():
        return f"{value:.1f}", True
    return value if isinstance(value, str) else str(value), True


def _side(column: Column, kind: str, value: Any) -> Column:
    """The column as the literal needs it: a boolean meets a number as 0 or 1."""
    return column.cast("int") if kind == "boolean" and not isinstance(value, bool) else column


def compare(column: Column, kind: str, op: str, value: Any) -> Column:
    """One comparison of a column with a literal, which is brought to the column's kind and never the reverse."""
    if op in ("IN", "NOT IN"):
        return is_in(column, kind, value, op == "NOT IN")
    if op.endswith("LIKE"):
        return like(column, value, "ILIKE" in op, op.startswith("NOT"))
    if value is None:
        return {"IS": column.isNull(), "IS NOT": column.isNotNull()}.get(op, F.lit(None).cast("boolean"))
    value, fits = coerce(value, kind)
    if not fits:  # text sorts after all numbers
        known = {"IS": F.lit(False), "IS NOT": F.lit(True)}.get(op)
        return known if known is not None else F.when(column.isNotNull(), F.lit(op in ("!=", "<", "<=")))
    column = _side(column, kind, value)
    return {
        "=": column == value, "!=": column != value, "<": column < value, ">": column > value, "<=": column <= value, ">=": column >= value,
        "IS": column.eqNullSafe(F.lit(value)), "IS NOT": ~column.eqNullSafe(F.lit(value)),
    }[op]


def is_in(column: Column, kind: str, values: tuple, negated: bool) -> Column:
    """An empty list is constant, even for NULL; a NULL member leaves a miss unknown."""
    if not values:
        return F.lit(negated)
    fitting = [v for v, fits in (coerce(v, kind) for v in values if v is not None) if fits]
    whole = [v for v in fitting if isinstance(v, bool)]
    other = [v for v in fitting if not isinstance(v, bool)]
    hits = [c for c in ((column.isin(whole) if whole else None), (_side(column, kind, 0).isin(other) if other else None)) if c is not None]
    hit = reduce(lambda a, b: a | b, hits) if hits else F.when(column.isNotNull(), F.lit(False))
    if None in values:
        hit = hit | F.lit(None).cast("boolean")
    return ~hit if negated else hit


def like_pattern(pattern: str) -> str:
    """The pattern with an escape only where one is needed; a trailing backslash is refused."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
            if at == len(pattern):
                raise RequestError("a LIKE pattern can't end in a backslash")
            c = pattern[at]
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append(c)
        at += 1
    return "".join(out)


def like(column: Column, pattern: str | None, fold_case: bool, negated: bool) -> Column:
    """LIKE, case-sensitive, or with ASCII letters folded on both sides."""
    if pattern is None:
        return F.lit(None).cast("boolean")
    pattern, text = like_pattern(pattern), column.cast("string")
    if fold_case:
        pattern, text = pattern.translate(str.maketrans(UPPER, LOWER)), F.translate(text, UPPER, LOWER)
    hit = text.like(pattern)
    return ~hit if negated else hit


def literals(left: Any, op: str, right: Any) -> Column:
    """A comparison of two literals, as permission rules use to allow or deny all."""
    kind = "boolean" if isinstance(left, bool) else "number" if isinstance(left, (int, float)) else "string"
    typed = F.lit(left) if left is not None else F.lit(None).cast("string")
    return compare(typed, kind, op, right)


def total_order(order_by, primary_key) -> list[tuple[str, str]]:
    """The order with the key columns that it lacks, ascending."""
    named = {c for c, _ in order_by}
    return [*order_by, *((c, "asc") for c in primary_key if c not in named)]


def sort_columns(order: list[tuple[str, str]], prefix: str = "") -> list[Column]:
    """NULL is the smallest value: first ascending, last descending."""
    return [F.col(prefix + c).asc_nulls_first() if d == "asc" else F.col(prefix + c).desc_nulls_last() for c, d in order]


def past(column: Column, kind: str, direction: str, value: Any, inclusive: bool) -> Column:
    if direction == "asc":
        if value is None:
            return F.lit(True) if inclusive else column.isNotNull()
        return compare(column, kind, ">=" if inclusive else ">", value)
    if value is None:
        return column.isNull() if inclusive else F.lit(False)
    return compare(column, kind, "<=" if inclusive else "<", value) | column.isNull()


def after_cursor(order: list[tuple[str, str]], kinds: dict[str, str], row: dict[str, Any], exclusive: bool) -> Column:
    """Rows after (or at) a cursor row: some key is past its value and all earlier keys equal theirs."""
    if missing := [c for c, _ in order if c not in row]:
        raise RequestError(f"the cursor lacks {missing}")
    ways = []
    for i, (c, d) in enumerate(order):
        same = [compare(F.col(e), kinds[e], "IS", row[e]) for e, _ in order[:i]]
        here = past(F.col(c), kinds[c], d, row[c], not exclusive and i == len(order) - 1)
        ways.append(reduce(lambda a, b: a & b, [*same, here]))
    return reduce(lambda a, b: a | b, ways)
