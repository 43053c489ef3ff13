"""Maintained aggregates: count and sum by group, from scratch and from deltas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, RequestError
from .ranks import running

NAME = re.compile(r"^[A-Za-z][A-Za-z0-9_]{0,62}$")


@dataclass(frozen=True)
class Aggregate:
    """``group``: source column -> key column of the target; ``sums``: target column -> source column.
    ``existing``: the target is a table of parents that keeps rows without children, at 0."""

    name: str
    source: str
    group: dict[str, str]
    count: str | None = None
    sums: dict[str, str] = field(default_factory=dict)
    target: str | None = None

    @property
    def columns(self) -> list[str]:
        return [*([self.count] if self.count else []), *self.sums]


def validate(definitions: list[Aggregate], catalog: Catalog) -> None:
    owners: dict[tuple[str, str], str] = {}
    names = set()
    sources = {d.source for d in definitions}
    for d in definitions:
        if not NAME.match(d.name) or d.name.lower() in names:
            raise RequestError(f"{d.name!r} is no free aggregate name")
        names.add(d.name.lower())
        spec = catalog.spec(d.source)
        for c in (*d.group, *d.sums.values()):
            if c not in spec.columns:
                raise RequestError(f"{d.name}: {d.source} has no column {c!r}")
        for c in d.sums.values():
            if spec.columns[c] != "number":
                raise RequestError(f"{d.name}: {c!r} is no number")
        if not d.group or not d.columns or len(set(d.group.values())) < len(d.group):
            raise RequestError(f"{d.name}: needs a one-to-one grouping and an aggregate column")
        if d.target is None:
            if d.count is None:
                raise RequestError(f"{d.name}: a materialized aggregate needs a count")
            continue
        target = catalog.spec(d.target)
        if d.target == d.source or d.target in sources:
            raise RequestError(f"{d.name}: an aggregate can't feed an aggregate")
        if set(d.group.values()) != set(target.primary_key):
            raise RequestError(f"{d.name}: the grouping must give the target's whole key")
        for c in d.columns:
            if c in target.primary_key or owners.setdefault((d.target, c), d.name) != d.name:
                raise RequestError(f"{d.name}: {c!r} is not free in {d.target}")


def full(source: DataFrame, d: Aggregate) -> DataFrame:
    """The aggregate from scratch. NULLs count 0 in sums; NULL group values are a group."""
    aggs = [*([F.count("*").alias(d.count)] if d.count else []), *(F.coalesce(F.sum(c), F.lit(0)).alias(t) for t, c in d.sums.items())]
    return source.groupBy(*(F.col(s).alias(t) for s, t in d.group.items())).agg(*aggs)


def backfill_existing(parents: DataFrame, source: DataFrame, d: Aggregate) -> DataFrame:
    """The parents with their aggregate columns; null-safe on the keys, 0 without children."""
    aggs = full(source, d)
    keys = list(d.group.values())
    for k in keys:
        aggs = aggs.withColumnRenamed(k, f"agg_{k}")
    on = [parents[k].eqNullSafe(aggs[f"agg_{k}"]) for k in keys]
    kept = [parents[c] for c in parents.columns if c not in d.columns]
    return parents.join(aggs, on, "left").select(*kept, *(F.coalesce(aggs[c], F.lit(0)).alias(c) for c in d.columns))


def delta(changes: DataFrame, d: Aggregate) -> DataFrame:
    """Signed sums by group of changes with row images ``old`` and ``new`` (structs, NULL where there is none)."""
    sides = [changes.where(f"{side} IS NOT NULL").select(F.lit(sign).alias("sign"), *(F.col(f"{side}.{c}").alias(c) for c in dict.fromkeys([*d.group, *d.sums.values()]))) for side, sign in (("old", -1), ("new", 1))]
    rows = sides[0].unionByName(sides[1])
    aggs = [*([F.sum("sign").alias(d.count)] if d.count else []), *(F.coalesce(F.sum(F.col("sign") * F.col(c)), F.lit(0)).alias(t) for t, c in d.sums.items())]
    return rows.groupBy(*(F.col(s).alias(t) for s, t in d.group.items())).agg(*aggs)


def merge(current: DataFrame, change: DataFrame, d: Aggregate) -> DataFrame:
    """The materialized aggregate after a delta; groups whose count falls to 0 go."""
    keys = list(d.group.values())
    rows = current.select(*keys, *d.columns).unionByName(change.select(*keys, *d.columns))
    out = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in d.columns))
    return out.where(F.col(d.count) > 0)


def merge_existing(parents: DataFrame, change: DataFrame, d: Aggregate) -> DataFrame:
    """The parents after a delta; groups without a parent are left alone."""
    keys = list(d.group.values())
    moved = change.select(*keys, *(F.col(c).alias(f"d_{c}") for c in d.columns))
    rows = parents.join(moved, keys, "left")
    return rows.select(*(c for c in parents.columns if c not in d.columns), *((F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in d.columns))


def nearest_rank(df: DataFrame, value: str, percents: list[float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles: the value at index floor(p / 100 * n) in ascending order, the last at most.
    Equal values are counted first; running counts over value ranges find the asked ranks, so no group is
    sorted in one task and no list is built."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranks = running(counts.withColumn("all", F.lit(0)), [*by, "all"], ["value"], upto="n")
    sizes = ranks.groupBy(*by, "all").agg(F.max("upto").alias("size"))
    wanted = F.array(*(F.struct(F.lit(float(p)).alias("p"), F.least(F.floor(F.lit(float(p)) / 100 * F.col("size")), F.col("size") - 1).alias("i")) for p in percents))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "all")]
    rows = ranks.alias("r").join(sizes.withColumn("wanted", wanted).alias("s"), same)
    hit = F.filter("wanted", lambda w: (w["i"] < F.col("upto")) & (w["i"] >= F.col("upto") - F.col("n")))
    return rows.select(*(F.col(f"r.{c}").alias(c) for c in by), "value", F.explode(hit).alias("w")).select(*by, "w.p", "value")
