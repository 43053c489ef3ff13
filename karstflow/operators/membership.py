"""Query membership: which rows a group's queries hold, and the row patches that changes give.

State tables (plain DataFrames): ``query_rows(query, row_table, row_pk)``,
``row_refs(row_table, row_pk, refs, added, removed)``. Each step is one batch of joins and sums for
all queries of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ast import Query
from ..plans.catalog import Catalog
from ..plans.planner import check, closure, probe

KEY = ["row_table", "row_pk"]


def members(queries: dict[str, Query], catalog: Catalog) -> DataFrame:
    """(query, row_table, row_pk) of all rows that the queries hold now."""
    return reduce(DataFrame.unionByName, (closure(q, catalog).withColumn("query", F.lit(h)) for h, q in queries.items())).select("query", *KEY)


def touched_queries(queries: dict[str, Query], tables: set[str], computed: set[str]) -> dict[str, Query]:
    """The queries to recompute: those not computed yet and those that depend on a touched table."""
    return {h: q for h, q in queries.items() if h not in computed or q.tables() & tables}


def describe(spark: SparkSession, queries: dict[str, Query], catalog: Catalog, version: int) -> DataFrame:
    """Definitions (query, definition, root_table, dependencies, version) of queries that pass all checks."""
    for q in queries.values():
        check(q, catalog)
    rows = [(h, repr(q), q.table, sorted(q.tables()), version) for h, q in queries.items()]
    return spark.createDataFrame(rows, "query string, definition string, root_table string, dependencies array<string>, version long")


def register(known: DataFrame, asked: DataFrame) -> DataFrame:
    """The definitions after some are asked for, with ``computed``: a new definition, or one that is changed or of another
    version, is to be computed anew; the others keep their mark."""
    new = asked.select("query", F.struct("definition", "root_table", "dependencies", "version").alias("new"))
    both = known.select("query", F.struct("definition", "root_table", "dependencies", "version").alias("old"), "computed").join(new, "query", "full")
    same = (F.col("old.definition") == F.col("new.definition")) & (F.col("old.version") == F.col("new.version"))
    computed = F.coalesce("computed", F.lit(False)) & (F.col("new").isNull() | F.coalesce(same, F.lit(False)))
    return both.select("query", F.coalesce("new", "old").alias("d"), computed.alias("computed")).select("query", "d.*", "computed")


def change_version(known: DataFrame, query_rows: DataFrame, clients: DataFrame, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(definitions, query_rows, clients) under the server's version: definitions of another one are to be computed
    anew and their rows go; a client (client, version) that saw another one is to be ``reset``, once."""
    old = known.where(F.col("version") != version)
    definitions = known.withColumns({"computed": F.col("computed") & (F.col("version") == version), "version": F.lit(version).cast("long")})
    seen = clients.select("client", F.lit(version).cast("long").alias("version"), (~F.col("version").eqNullSafe(F.lit(version))).alias("reset"))
    return definitions, query_rows.join(old.select("query"), "query", "left_anti"), seen


def narrowed(query: Query, catalog: Catalog, changed: DataFrame, held: DataFrame) -> DataFrame:
    """The changed keys of the query's own table that can alter its result: rows it holds now, or that pass its condition."""
    pk = list(catalog.spec(query.table).primary_key)
    return changed.select(*pk).join(held.select(*pk), pk, "left_semi").unionByName(probe(query, catalog, changed)).distinct()


def membership_diff(live: DataFrame, durable: DataFrame) -> DataFrame:
    """(query, row_table, row_pk, change): 1 for rows that came, -1 for rows that went."""
    both = live.select("query", *KEY, F.lit(1).alias("n")).unionByName(durable.select("query", *KEY, F.lit(-1).alias("n")))
    return both.groupBy("query", *KEY).agg(F.sum("n").cast("int").alias("change")).where("change <> 0")


def released(durable: DataFrame, desired: DataFrame) -> DataFrame:
    """Rows of queries that no client desires any more, as a diff."""
    gone = durable.join(desired.select("query").distinct(), "query", "left_anti")
    return gone.select("query", *KEY, F.lit(-1).alias("change"))


def net_delta(diff: DataFrame) -> DataFrame:
    """The signed change of each row's reference count over all queries."""
    return diff.groupBy(*KEY).agg(F.sum("change").alias("delta")).where("delta <> 0")


def apply_delta(refs: DataFrame, delta: DataFrame, version: int) -> DataFrame:
    """The new ``row_refs``, with ``op``: put (0 -> n), del (n -> 0, kept as a tombstone), NULL (no transition)."""
    rows = refs.join(delta, KEY, "full")
    before, after = F.coalesce("refs", F.lit(0)), F.coalesce("refs", F.lit(0)) + F.coalesce("delta", F.lit(0))
    came, went = (before <= 0) & (after > 0), (before > 0) & (after <= 0)
    return rows.select(
        *KEY, after.cast("long").alias("refs"),
        F.when(came, F.lit(version).cast("long")).otherwise(F.col("added")).alias("added"),
        F.when(went, F.lit(version).cast("long")).when(came, F.lit(None).cast("long")).otherwise(F.col("removed")).alias("removed"),
        F.when(came, "put").when(went, "del").alias("op"),
    )


def prune(refs: DataFrame, floor: int) -> DataFrame:
    """Without the tombstones that every client has passed."""
    return refs.where(~((F.col("refs") <= 0) & (F.coalesce("removed", F.lit(0)) <= floor)))


def row_patch(refs: DataFrame, changed: DataFrame, recomputed_rows: DataFrame, full_rows: DataFrame | None = None) -> DataFrame:
    """(op, row_table, row_pk): transitions, then puts of changed rows still held by a recomputed query,
    then all rows of newly desired queries; one entry for each row."""
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast("string")

    def marked(df: DataFrame, changed=no, live=no, full=no) -> DataFrame:
        return df.select(*KEY, none.alias("op"), no.alias("held"), changed.alias("changed"), live.alias("live"), full.alias("full"))

    parts = refs.select(*KEY, "op", (F.col("refs") > 0).alias("held"), no.alias("changed"), no.alias("live"), no.alias("full"))
    parts = parts.unionByName(marked(changed, changed=yes)).unionByName(marked(recomputed_rows, live=yes))
    if full_rows is not None:
        parts = parts.unionByName(marked(full_rows, full=yes))
    rows = parts.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("op", "held", "changed", "live", "full")))  # one shuffle for all of it
    op = F.coalesce("op", F.when((F.col("changed") & F.col("live") & F.col("held")) | F.col("full"), "put"))
    return rows.select(op.alias("op"), *KEY).where("op IS NOT NULL")


def replay(refs: DataFrame, cookie: int) -> DataFrame:
    """(op, row_table, row_pk) of the transitions after ``cookie``."""
    return refs.select(F.when((F.col("refs") > 0) & (F.col("added") > cookie), "put").when((F.col("refs") <= 0) & (F.col("removed") > cookie), "del").alias("op"), *KEY).where("op IS NOT NULL")


def full_patch(query_rows: DataFrame) -> DataFrame:
    """A whole response: one clear, then a put for every row held."""
    clear = query_rows.sparkSession.createDataFrame([(0, "clear", None, None)], "seq int, op string, row_table string, row_pk string")
    return clear.unionByName(query_rows.select(*KEY).distinct().select(F.lit(1).alias("seq"), F.lit("put").alias("op"), *KEY))


def with_values(patch: DataFrame, table: str, catalog: Catalog) -> DataFrame:
    """The patch entries of one table with the live row as JSON under stored names; a put without a live row is skipped."""
    from ..functions.values import canonical_pk

    spec = catalog.spec(table)
    columns = [F.col(c).alias(spec.physical.get(c, c)) for c in spec.columns]
    live = catalog.scan(table).select(canonical_pk(*spec.primary_key).alias("row_pk"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    rows = patch.where(F.col("row_table") == table).join(live, "row_pk", "left")
    keep: Column = (F.col("op") != "put") | F.col("value").isNotNull()
    return rows.where(keep).select("op", F.lit(spec.stored_as or table).alias("table_name"), F.col("row_pk").alias("id"), F.when(F.col("op") == "put", F.col("value")).alias("value"))


def cursor_diff(touched: DataFrame, live: DataFrame, pk: list[str]) -> DataFrame:
    """Each touched key once: put if its row lives, del if it is gone."""
    keys = touched.select(*pk).distinct()
    return keys.join(live.select(*pk, F.lit(True).alias("live")), pk, "left").select(F.when(F.col("live"), "put").otherwise("del").alias("op"), *pk)


def response_mode(cookie: int | None, floor: int, head: int, reset: bool = False, query_changes: bool = False) -> str:
    """full, diff or unchanged; a cookie ahead of the head is refused."""
    from ..plans.catalog import RequestError

    if cookie is not None and cookie > head:
        raise RequestError("the cookie is ahead of the server", 409)
    if cookie is None or cookie < floor or reset:
        return "full"
    return "unchanged" if cookie == head and not query_changes else "diff"
