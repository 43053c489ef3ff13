"""Which clients desire which queries: small state tables, changed batch by batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import RequestError


def apply_patch(desires: DataFrame, patch: DataFrame) -> DataFrame:
    """``desires`` (client, query) after a patch (seq, client, op, query): put, del, or clear of all a client's
    queries. Of each pair the last entry counts, and a clear counts for every query before it."""
    cleared = patch.where("op = 'clear'").groupBy("client").agg(F.max("seq").alias("cleared"))
    last = patch.where("op <> 'clear'").groupBy("client", "query").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    both = desires.select("client", "query", F.lit(True).alias("had")).join(last, ["client", "query"], "full").join(cleared, "client", "left")
    after = F.col("op").isNotNull() & (F.col("cleared").isNull() | (F.col("seq") > F.col("cleared")))
    keep = F.when(after, F.col("op") == "put").otherwise(F.coalesce("had", F.lit(False)) & F.col("cleared").isNull())
    return both.where(keep).select("client", "query")


def acknowledge(acks: DataFrame, new: DataFrame) -> DataFrame:
    """Each client's acknowledged version; it never falls."""
    return acks.select("client", "version").unionByName(new.select("client", "version")).groupBy("client").agg(F.max("version").alias("version"))


def delete_clients(desires: DataFrame, clients: list[str], own: str) -> DataFrame:
    """Without the desires of at most 64 other clients."""
    if len(clients) > 64 or own in clients:
        raise RequestError("at most 64 other clients can be deleted")
    return desires.where(~F.col("client").isin(clients)) if clients else desires


def got_queries(before: DataFrame, after: DataFrame, client: str) -> DataFrame:
    """(op, query): dels for what the client desired and lost, then puts for all it desires."""
    old, new = (d.where(F.col("client") == client).select("query") for d in (before, after))
    gone = old.join(new, "query", "left_anti").select(F.lit("del").alias("op"), "query")
    return gone.unionByName(new.select(F.lit("put").alias("op"), "query"))


def owners_match(rows: DataFrame, user: str) -> DataFrame:
    """(row_table, row_pk) of member rows (refs > 0) all of whose owners are ``user``."""
    held = rows.where("refs > 0").groupBy("row_table", "row_pk").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"))
    return held.where((F.col("lo") == user) & (F.col("hi") == user)).select("row_table", "row_pk")


def overlay(base: DataFrame, pending: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Aggregates with a client's pending deltas added, as it shows them before the server has applied them;
    groups that the base lacks are left alone. A null key or a delta that is no finite number is refused."""
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    odd = [F.col(k).isNull() for k in keys] + [~finite(c) for c in columns]
    if not pending.where(reduce(lambda a, b: a | b, odd)).isEmpty():
        raise RequestError("a pending delta has a null key or no finite value")
    deltas = pending.groupBy(*keys).agg(*(F.sum(c).alias(f"d_{c}") for c in columns))
    rows = base.join(deltas, keys, "left")
    return rows.select(*(c for c in base.columns if c not in columns), *((F.col(c) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in columns))
