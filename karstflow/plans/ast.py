"""The query grammar as dataclasses, with a strict reader of its JSON form."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from .catalog import RequestError

OPERATORS = ("=", "!=", "IS", "IS NOT", "<", ">", "<=", ">=", "LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE", "IN", "NOT IN")
Scalar = None | bool | int | float | str


@dataclass(frozen=True)
class Simple:
    op: str
    column: str | None
    literal: Any  # the left side where column is None
    value: Any


@dataclass(frozen=True)
class Junction:
    kind: str  # and, or
    conditions: tuple


@dataclass(frozen=True)
class Exists:
    negated: bool
    related: Related


@dataclass(frozen=True)
class Start:
    row: dict[str, Any]
    exclusive: bool


@dataclass(frozen=True)
class Query:
    table: str
    alias: str | None = None
    where: Simple | Junction | Exists | None = None
    related: tuple[Related, ...] = ()
    order_by: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    start: Start | None = None

    def tables(self) -> set[str]:
        """The tables whose changes can change the result."""
        out = {self.table}
        for r in (*self.related, *subqueries(self.where)):
            out |= r.query.tables()
        return out


@dataclass(frozen=True)
class Related:
    parent: tuple[str, ...]
    child: tuple[str, ...]
    query: Query
    hidden: bool = False


def subqueries(where) -> list[Related]:
    if isinstance(where, Exists):
        return [where.related]
    return [r for c in where.conditions for r in subqueries(c)] if isinstance(where, Junction) else []


def _keys(x: Any, what: str, need: set[str], may: set[str] = frozenset()) -> dict:
    if not isinstance(x, dict):
        raise RequestError(f"{what} must be an object")
    if missing := need - x.keys():
        raise RequestError(f"{what} lacks {sorted(missing)}")
    if odd := x.keys() - need - may:
        raise RequestError(f"{what} has unknown keys {sorted(odd)}")
    return x


def _text(x: Any, what: str) -> str:
    if not isinstance(x, str) or not x:
        raise RequestError(f"{what} must be a non-empty string")
    return x


def _scalar(x: Any, what: str) -> Scalar:
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    raise RequestError(f"{what} must be a scalar")


def parse(x: Any) -> Query:
    """Read a query's JSON form; any key, type or operator outside the grammar is refused."""
    _keys(x, "query", {"table"}, {"alias", "schema", "where", "related", "orderBy", "limit", "start"})
    for k in ("alias", "schema"):
        if k in x:
            _text(x[k], k)
    limit = x.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise RequestError("limit must be a whole number of 0 or more")
    order = []
    for pair in x.get("orderBy") or ():
        if not isinstance(pair, list | tuple) or len(pair) != 2 or pair[1] not in ("asc", "desc"):
            raise RequestError("orderBy takes [column, asc or desc]")
        order.append((_text(pair[0], "orderBy column"), pair[1]))
    start = None
    if "start" in x:
        s = _keys(x["start"], "start", {"row", "exclusive"})
        if not isinstance(s["row"], dict) or not isinstance(s["exclusive"], bool):
            raise RequestError("start takes a row and a boolean")
        if not order:
            raise RequestError("start needs orderBy")
        start = Start({k: v for k, v in s["row"].items() if v is None or isinstance(v, (bool, int, float, str))}, s["exclusive"])
    where = parse_condition(x["where"]) if "where" in x else None
    related = x.get("related", [])
    if not isinstance(related, list):
        raise RequestError("related must be a list")
    return Query(_text(x["table"], "table"), x.get("alias"), where, tuple(parse_related(r) for r in related), tuple(order), limit, start)


def parse_related(x: Any) -> Related:
    _keys(x, "related", {"correlation", "subquery"}, {"hidden", "system"})
    c = _keys(x["correlation"], "correlation", {"parentField", "childField"})
    sides = [c["parentField"], c["childField"]]
    if not all(isinstance(s, list) and s for s in sides) or len(sides[0]) != len(sides[1]):
        raise RequestError("correlation takes two lists of equal length")
    if not isinstance(x.get("hidden", False), bool):
        raise RequestError("hidden must be a boolean")
    if x.get("system", "client") not in ("permissions", "client", "test"):
        raise RequestError("unknown system")
    return Related(*(tuple(_text(f, "field") for f in s) for s in sides), parse(x["subquery"]), x.get("hidden", False))


def parse_condition(x: Any):
    if not isinstance(x, dict):
        raise RequestError("a condition must be an object")
    kind = x.get("type")
    if kind in ("and", "or"):
        _keys(x, kind, {"type", "conditions"})
        if not isinstance(x["conditions"], list):
            raise RequestError("conditions must be a list")
        return Junction(kind, tuple(parse_condition(c) for c in x["conditions"]))
    if kind == "correlatedSubquery":
        _keys(x, kind, {"type", "op", "related"}, {"flip", "scalar"})
        if x["op"] not in ("EXISTS", "NOT EXISTS") or not isinstance(x.get("flip", False), bool) or x.get("scalar", False) is not False:
            raise RequestError("unsupported correlated subquery")
        return Exists(x["op"] == "NOT EXISTS", parse_related(x["related"]))
    if kind != "simple":
        raise RequestError(f"unknown condition type {kind!r}")
    _keys(x, kind, {"type", "op", "left", "right"})
    if x["op"] not in OPERATORS:
        raise RequestError(f"unknown operator {x['op']!r}")
    left, right = x["left"], x["right"]
    if not isinstance(left, dict) or not isinstance(right, dict) or right.get("type") != "literal":
        raise RequestError("a comparison's right side must be a literal")
    _keys(right, "right", {"type", "value"})
    value = right["value"]
    if x["op"] in ("IN", "NOT IN"):
        if not isinstance(value, list):
            raise RequestError("IN takes a list")
        value = tuple(_scalar(v, "list member") for v in value)
    else:
        _scalar(value, "right side")
    if x["op"].endswith("LIKE") and value is not None and not isinstance(value, str):
        raise RequestError("LIKE takes a string")
    if left.get("type") == "column":
        _keys(left, "left", {"type", "name"})
        return Simple(x["op"], _text(left["name"], "column"), None, value)
    if left.get("type") != "literal":
        raise RequestError("a comparison's left side must be a column or a literal")
    _keys(left, "left", {"type", "value"})
    return Simple(x["op"], None, _scalar(left["value"], "left side"), value)


# ---- the builder ----


class Q:
    """``Q('orders').where('o_totalprice', '>', 5).order_by('o_orderdate', 'desc').limit(3).ast``"""

    def __init__(self, table: str, ast: Query | None = None, single: bool = False):
        self.ast, self.single = ast or Query(table), single

    def _with(self, **kw) -> Q:
        return Q(self.ast.table, replace(self.ast, **kw), self.single)

    def where(self, column, op=None, *value) -> Q:
        """``where(column, value)``, ``where(column, op, value)`` or ``where(condition)``; True and False allow and deny all."""
        if isinstance(column, bool):
            cond = Simple("=", None, 0 if column else 1, 0)
        elif isinstance(column, str):
            cond = cmp(column, op, *value) if value else cmp(column, "=", op)
        else:
            cond = column
        both = cond if self.ast.where is None else Junction("and", (self.ast.where, cond))
        return self._with(where=both)

    def where_exists(self, rel: tuple, query: Q | None = None, negated: bool = False) -> Q:
        return self.where(exists(rel, query, negated))

    def related(self, alias: str, rel: tuple, query: Q | None = None, hidden: bool = False) -> Q:
        """``rel``: (child table, parent columns, child columns)."""
        sub = replace((query or Q(rel[0])).ast, alias=alias)
        return self._with(related=(*self.ast.related, Related(_tuple(rel[1]), _tuple(rel[2]), sub, hidden)))

    def order_by(self, column: str, direction: str = "asc") -> Q:
        return self._with(order_by=(*self.ast.order_by, (column, direction)))

    def start(self, row: dict, inclusive: bool = False) -> Q:
        return self._with(start=Start(row, not inclusive))

    def limit(self, n: int) -> Q:
        return self._with(limit=n)

    def one(self) -> Q:
        out = self._with(limit=min(1, 1 if self.ast.limit is None else self.ast.limit))
        out.single = True
        return out


def _tuple(x) -> tuple[str, ...]:
    return (x,) if isinstance(x, str) else tuple(x)


def cmp(column: str, op: str, value: Any) -> Simple:
    return Simple(op, column, None, tuple(value) if isinstance(value, list) else value)


def and_(*conditions) -> Junction:
    return Junction("and", conditions)


def or_(*conditions) -> Junction:
    return Junction("or", conditions)


def exists(rel: tuple, query: Q | None = None, negated: bool = False) -> Exists:
    return Exists(negated, Related(_tuple(rel[1]), _tuple(rel[2]), (query or Q(rel[0])).ast))
