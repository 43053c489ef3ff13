"""Named queries, permissions and guarded execution."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame

from .ast import Junction, Q, Query, Simple, Start
from .catalog import Catalog, RequestError
from .planner import all_rows, flat, order_of

Builder = Callable[[Any, Any], Q]


class Registry:
    """Query builders by dotted path: ``registry.add("orders.open", lambda args, user: Q(...))``."""

    def __init__(self):
        self.builders: dict[str, Builder] = {}

    def add(self, name: str, build: Builder) -> None:
        if name in self.builders:
            raise RequestError(f"{name!r} is taken")
        self.builders[name] = build

    def resolve(self, asked: list[tuple[str, Any]], user: Any = None, tolerate: bool = False) -> list[Query]:
        """The queries of (name, args) pairs in order. An unknown name is refused, or left out where tolerated;
        a builder's own error always counts."""
        out, seen = [], {}
        for name, args in asked:
            if name not in self.builders:
                if tolerate:
                    continue
                raise RequestError(f"unknown query {name!r}")
            key = (name, repr(args))
            if key not in seen:
                seen[key] = self.builders[name](args, user).ast
            out.append(seen[key])
        return out


def server_where(condition, on_client: bool):
    """A condition that only the server checks: on a client all rows pass."""
    return Simple("=", None, 0, 0) if on_client else condition


def with_permission(query: Query, condition) -> Query:
    """The query with a permission condition beside its own."""
    return replace(query, where=condition if query.where is None else Junction("and", (condition, query.where)))


def may(catalog: Catalog, table: str, key: dict[str, Any], condition, admin: bool = False) -> bool:
    """Whether the row with this key exists and passes the permission condition; an admin only needs the row."""
    spec = catalog.spec(table)
    if set(key) != set(spec.primary_key):
        raise RequestError(f"{table}: the whole key is needed")
    same = tuple(Simple("=", c, None, v) for c, v in key.items())
    where = Junction("and", same if admin else (*same, condition))
    return not flat(Query(table, None, where, (), (), 1), catalog).isEmpty()


def guarded(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df``, refused if it has more than ``max_rows`` rows; at most one more is read to know."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise RequestError(f"the result has more than {max_rows} rows")
    return df


def within_budget(query: Query, catalog: Catalog, max_selects: int = 256, max_rows: int = 10_000) -> list[tuple[str, DataFrame]]:
    """``all_rows`` of the query, refused if one select for each parent row and relation would be more than
    ``max_selects``, or if all levels hold more than ``max_rows``; no level is counted further than that."""
    levels, selects, rows = all_rows(query, catalog), 1, 0
    relations = {path: sum(other.rpartition("/")[0] == path for other, _ in levels) for path, _ in levels}
    for path, df in levels:
        n = df.limit(max(max_selects, max_rows) + 1).count()
        selects, rows = selects + n * relations[path], rows + n
        if selects > max_selects or rows > max_rows:
            raise RequestError(f"the query takes more than {max_selects} selects or {max_rows} rows")
    return levels


def batches(query: Query, catalog: Catalog, size: int) -> Iterator[DataFrame]:
    """A query's result in pages of ``size`` rows, each continued after the last row of the one before."""
    order = order_of(query, catalog)
    left = query.limit
    paged = replace(query, order_by=tuple(order))
    while left is None or left > 0:
        n = size if left is None else min(size, left)
        page = flat(replace(paged, limit=n), catalog)
        keys = page.select(*(c for c, _ in order)).collect()  # a page's keys
        if keys:
            yield page
        if len(keys) < n:
            return
        left = None if left is None else left - n
        paged = replace(paged, start=Start(keys[-1].asDict(), True))
