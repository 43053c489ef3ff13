"""Rolling budgets, breakers and lag, as range windows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_sum(events: DataFrame, by: list[str], at_ms: str, amount: str, window_ms: int, bucket_ms: int = 1000) -> DataFrame:
    """by, bucket and the sum over the last ``window_ms``: amounts are added up by bucket first, so the window
    runs over buckets and not over events."""
    bucket = F.floor(F.col(at_ms) / bucket_ms).cast("long")
    sums = events.groupBy(*by, bucket.alias("bucket")).agg(F.sum(amount).alias("amount"))
    span = Window.partitionBy(*by).orderBy("bucket").rangeBetween(-(window_ms // bucket_ms) + 1, 0)
    return sums.withColumn("rolling", F.sum("amount").over(span))


def tripped(rolling: DataFrame, by: list[str], budget: float) -> DataFrame:
    """The first bucket of each group that is over budget; a trip is sticky."""
    return rolling.where(F.col("rolling") > budget).groupBy(*by).agg(F.min("bucket").alias("bucket"), F.min_by("rolling", "bucket").alias("rolling"))


def breaker(rolling: DataFrame, by: list[str], budget: float, initial_ms: int, cap_ms: int) -> DataFrame:
    """All over-budget buckets, numbered within their group, with the pause that doubles up to a cap."""
    trips = rolling.where(F.col("rolling") > budget)
    n = F.row_number().over(Window.partitionBy(*by).orderBy("bucket"))
    pause = F.least(F.lit(float(cap_ms)), F.lit(float(initial_ms)) * F.pow(F.lit(2.0), F.least(F.col("trip") - 1, F.lit(40))))
    return trips.withColumn("trip", n).withColumn("pause_ms", pause.cast("long"))


def serving_lag(commits: DataFrame, serves: DataFrame) -> DataFrame:
    """Of each commit (group, version, at) the lag until its group was first served up to it: 0 at least, NULL if never.

    The first serve at or past a version is a running minimum over versions, read from the top down: one
    sort by group instead of a join of all pairs."""
    rows = commits.select("group", "version", F.col("at").alias("committed"), F.lit(None).cast("long").alias("served"))
    rows = rows.unionByName(serves.select("group", "version", F.lit(None).cast("long").alias("committed"), F.col("at").alias("served")))
    above = Window.partitionBy("group").orderBy(F.desc("version")).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.min("served").over(above)).where("committed IS NOT NULL")
    late = F.col("first") - F.col("committed")
    return rows.select("group", "version", F.when(late.isNotNull(), F.greatest(F.lit(0), late)).alias("lag"), (late < 0).alias("clamped"))


def retention_plan(files: DataFrame, now: int, max_age: int, max_bytes: int) -> DataFrame:
    """(name, reason) of the files to drop: those too old, then the oldest until the rest fits."""
    old = F.col("used_at") < now - max_age
    kept = files.where(~old)
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("used_at"), "name"))
    over = kept.withColumn("running", running).where(F.col("running") > max_bytes)
    return files.where(old).select("name", F.lit("age").alias("reason")).unionByName(over.select("name", F.lit("bytes").alias("reason")))
