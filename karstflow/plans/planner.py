"""Queries as DataFrames: flat rows, related rows, nested objects, dependent rows.

Correlations become semi, anti or left joins on the key columns, per-parent limits a window rank on
the child's key (which Spark plans as a group limit), so nothing runs once for each parent row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.values import canonical_pk
from .ast import Exists, Junction, Query, Related, Simple, subqueries
from .catalog import Catalog, RequestError


def check(query: Query, catalog: Catalog) -> None:
    """Refuse unknown columns and any use of an encrypted column but projection, at every level."""
    spec = catalog.spec(query.table)

    def usable(column: str, use: str) -> None:
        if column not in spec.columns:
            raise RequestError(f"{query.table} has no column {column!r}")
        if column in spec.encrypted:
            raise RequestError(f"{query.table}.{column} is encrypted and can't be used in {use}")

    def conditions(c) -> None:
        if isinstance(c, Junction):
            for x in c.conditions:
                conditions(x)
        elif isinstance(c, Simple) and c.column is not None:
            usable(c.column, "a condition")

    conditions(query.where)
    for c, _ in query.order_by:
        usable(c, "an order")
    if query.start is not None:
        for c, _ in exprs.total_order(query.order_by, spec.primary_key):
            usable(c, "a cursor")
    for r in (*query.related, *subqueries(query.where)):
        child = catalog.spec(r.query.table)
        for c in r.parent:
            usable(c, "a correlation")
        if r in subqueries(query.where) and r.query.limit == 0:
            continue
        for c in r.child:
            if c not in child.columns or c in child.encrypted:
                raise RequestError(f"{r.query.table}.{c} can't be used in a correlation")
        check(r.query, catalog)


def order_of(query: Query, catalog: Catalog) -> list[tuple[str, str]]:
    return exprs.total_order(query.order_by, catalog.spec(query.table).primary_key)


def child_keys(rel: Related, catalog: Catalog) -> DataFrame:
    """The distinct correlation keys of a subquery's rows; order and any limit but 0 don't matter."""
    rows = candidates(rel.query, catalog)
    return rows.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(rel.child))).dropna()


def on_keys(rel: Related) -> Column:
    return reduce(lambda a, b: a & b, (F.col(p) == F.col(f"k{i}") for i, p in enumerate(rel.parent)))


def apply_where(df: DataFrame, query: Query, catalog: Catalog) -> DataFrame:
    """Filter by the condition tree. EXISTS in a top-level AND is a semi (anti) join; anywhere else it
    is a left join to the distinct keys, whose mark then takes part in the expression."""
    spec, columns = catalog.spec(query.table), df.columns
    marks = 0

    def column(c) -> Column:
        nonlocal df, marks
        if isinstance(c, Simple):
            return exprs.literals(c.literal, c.op, c.value) if c.column is None else exprs.compare(F.col(c.column), spec.columns[c.column], c.op, c.value)
        if isinstance(c, Junction):
            start = F.lit(c.kind == "and")
            return reduce((lambda a, b: a & b) if c.kind == "and" else (lambda a, b: a | b), [column(x) for x in c.conditions], start)
        if c.related.query.limit == 0:
            return F.lit(c.negated)
        mark = f"exists_{marks}"
        marks += 1
        keys = child_keys(c.related, catalog).distinct().withColumn(mark, F.lit(True))
        df = df.join(keys, on_keys(c.related), "left").drop(*(f"k{i}" for i in range(len(c.related.parent))))
        return F.col(mark).isNull() if c.negated else F.col(mark).isNotNull()

    def top(c) -> None:
        nonlocal df
        if isinstance(c, Junction) and c.kind == "and":
            for x in sorted(c.conditions, key=lambda x: isinstance(x, Exists)):  # plain filters first, at the scan
                top(x)
        elif isinstance(c, Exists) and c.related.query.limit != 0:
            df = df.join(child_keys(c.related, catalog), on_keys(c.related), "left_anti" if c.negated else "left_semi")
        else:
            condition = column(c)  # adds the marks to df first
            df = df.where(condition)

    if query.where is not None:
        top(query.where)
    return df.select(*columns)


def candidates(query: Query, catalog: Catalog) -> DataFrame:
    """Rows that pass the condition and the cursor, in no order."""
    spec = catalog.spec(query.table)
    df = catalog.scan(query.table)
    if query.start is not None:
        df = df.where(exprs.after_cursor(order_of(query, catalog), spec.columns, query.start.row, query.start.exclusive))
    return apply_where(df, query, catalog)


def flat(query: Query, catalog: Catalog) -> DataFrame:
    """The query's own rows: ordered if it asks for an order, limited by the total order."""
    check(query, catalog)
    df = candidates(query, catalog)
    order = exprs.sort_columns(order_of(query, catalog))
    if query.limit is not None:
        return df.orderBy(*order).limit(query.limit)
    return df.orderBy(*order) if query.order_by else df


def ranked(df: DataFrame, keys: tuple[str, ...], query: Query, catalog: Catalog, name: str = "rn") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*exprs.sort_columns(order_of(query, catalog)))
    df = df.withColumn(name, F.row_number().over(window))
    return df if query.limit is None else df.where(F.col(name) <= query.limit)


def related_rows(parents: DataFrame, rel: Related, catalog: Catalog) -> DataFrame:
    """The child rows of any of ``parents``; with a limit, the first of each correlation key."""
    keys = parents.select(*(F.col(p).alias(f"k{i}") for i, p in enumerate(rel.parent))).dropna().distinct()
    on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"k{i}") for i, c in enumerate(rel.child)))
    df = candidates(rel.query, catalog).join(keys, on, "left_semi")
    return df if rel.query.limit is None else ranked(df, rel.child, rel.query, catalog).drop("rn")


def all_rows(query: Query, catalog: Catalog) -> list[tuple[str, DataFrame]]:
    """(path of aliases, rows) of the query and of all its related levels."""
    check(query, catalog)

    def below(df: DataFrame, q: Query, path: str) -> list[tuple[str, DataFrame]]:
        out = [(path, df)]
        for r in q.related:
            out += below(related_rows(df, r, catalog), r.query, f"{path}/{r.query.alias or r.query.table}")
        return out

    return below(flat(query, catalog), query, query.alias or query.table)


def closure(query: Query, catalog: Catalog) -> DataFrame:
    """(row_table, row_pk) of every row that the result depends on: root, related and all positive EXISTS rows."""
    check(query, catalog)
    parts: list[DataFrame] = []

    def visit(df: DataFrame, q: Query) -> None:
        pk = catalog.spec(q.table).primary_key
        parts.append(df.select(F.lit(q.table).alias("row_table"), canonical_pk(*pk).alias("row_pk")))
        for r in q.related:
            visit(related_rows(df, r, catalog), r.query)

        def inside(c) -> None:
            if isinstance(c, Junction):
                for x in c.conditions:
                    inside(x)
            elif isinstance(c, Exists) and not c.negated and c.related.query.limit != 0:
                sub = Query(c.related.query.table, None, c.related.query.where, c.related.query.related, c.related.query.order_by, None, c.related.query.start)
                visit(related_rows(df, Related(c.related.parent, c.related.child, sub), catalog), sub)

        inside(q.where)

    visit(flat(query, catalog), query)
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).distinct()  # one table's rows are distinct by their key


def probe(query: Query, catalog: Catalog, changed: DataFrame) -> DataFrame:
    """The changed primary keys whose rows pass the query's condition (order and limit aside)."""
    bare = Query(query.table, None, query.where, (), query.order_by, None, query.start)
    check(bare, catalog)
    pk = catalog.spec(query.table).primary_key
    return changed.select(*pk).distinct().join(candidates(bare, catalog).select(*pk), list(pk), "left_semi")


# ---- nested objects ----


def nested(query: Query, catalog: Catalog, singular: bool = False, singles: frozenset[str] = frozenset()) -> DataFrame:
    """One row for each root row: its columns and, for each related alias, an array of objects (or one
    object or NULL, for aliases in ``singles``, given as paths like ``orders.lines``)."""
    check(query, catalog)
    if singular:
        query = Query(query.table, query.alias, query.where, query.related, query.order_by, min(1, 1 if query.limit is None else query.limit), query.start)
    narrow = query.where is not None or query.start is not None or query.limit is not None
    rows = attach(flat(query, catalog), query, catalog, singles, "", narrow)
    return rows.orderBy(*exprs.sort_columns(order_of(query, catalog)))


def attach(df: DataFrame, query: Query, catalog: Catalog, singles: frozenset[str], path: str, narrow: bool = False) -> DataFrame:
    """``df`` with its related objects. Where it is not a whole table (``narrow``), children are first
    restricted to those of its rows, so only they are ranked and packed."""
    names = set(catalog.spec(query.table).columns)
    for n, r in enumerate(query.related):
        target = junction_target(r) if r.hidden else r
        alias = target.query.alias or ""
        if not alias or alias in names:
            raise RequestError(f"related needs an alias of its own, not {alias!r}")
        names.add(alias)
        here, keys = f"{path}{alias}", [f"{path}{alias}.".replace(".", "_") + f"_k{i}" for i in range(len(r.parent))]
        one = here in singles
        limit = min(1, 1 if target.query.limit is None else target.query.limit) if one else target.query.limit
        sub = Query(target.query.table, alias, target.query.where, target.query.related, target.query.order_by, limit, target.query.start)
        children = candidates(sub, catalog)
        asked = df.select(*(F.col(p).alias(k) for p, k in zip(r.parent, keys))).dropna().distinct() if narrow else None
        if r.hidden:
            link = catalog.scan(r.query.table).select(*(F.col(c).alias(k) for c, k in zip(r.child, keys)), *(F.col(p).alias(f"j{i}") for i, p in enumerate(target.parent)))
            link = link if asked is None else link.join(asked, keys, "left_semi")
            on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"j{i}") for i, c in enumerate(target.child)))
            children = children.join(link, on).drop(*(f"j{i}" for i in range(len(target.parent))))
        else:
            children = children.withColumns({k: F.col(c) for c, k in zip(r.child, keys)})
            children = children if asked is None else children.join(asked, keys, "left_semi")
        children = children.dropna(subset=keys)
        unique = one and limit == 1 and not r.hidden and set(catalog.spec(sub.table).primary_key) <= set(r.child)
        children = children.withColumn(f"rn{n}", F.lit(1)) if unique else ranked(children, tuple(keys), sub, catalog, f"rn{n}")
        children = attach(children, sub, catalog, singles, f"{here}.", narrow or sub.where is not None or limit is not None)
        own = [c for c in children.columns if c not in keys and c != f"rn{n}"]
        on = reduce(lambda a, b: a & b, (F.col(p) == F.col(k) for p, k in zip(r.parent, keys)))
        if one:  # a key has one row at most: no list
            df = df.join(children.select(*keys, F.struct(*own).alias(alias)), on, "left").drop(*keys)
            continue
        packed = F.array_sort(F.collect_list(F.struct(F.col(f"rn{n}").alias("rn"), F.struct(*own).alias("row"))))
        grouped = children.groupBy(*keys).agg(F.transform(packed, lambda x: x["row"]).alias(alias))
        df = df.join(grouped, on, "left").drop(*keys)
        df = df.withColumn(alias, F.coalesce(alias, F.array().cast(grouped.schema[alias].dataType)))
    return df


def junction_target(rel: Related) -> Related:
    """The one visible relation of a hidden junction, which may have nothing else."""
    q = rel.query
    if q.where is not None or q.start is not None or q.limit is not None or q.order_by or len(q.related) != 1 or q.related[0].hidden:
        raise RequestError("a hidden junction takes one visible relation and nothing else")
    return q.related[0]
