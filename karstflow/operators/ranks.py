"""Running totals over whole tables or large groups, without sorting any of them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle


def running(df: DataFrame, by: list[str], order: list[str], **weights: str) -> DataFrame:
    """``df`` with a column for each of ``weights`` (name -> column): its sum over the group ``by`` up to and with
    the row, in ``order`` (which tells rows of a group apart).

    Rows are range-partitioned once and written with their partition's number; totals by partition are
    summed over the partitions before, and only a partition's rows are sorted together."""
    keys = [*by, *order]
    dealt = settle(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part", *by).agg(*(F.sum(w).alias(f"sum_{n}") for n, w in weights.items()))
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("part", *by, *(F.coalesce(F.sum(f"sum_{n}").over(above), F.lit(0)).alias(f"from_{n}") for n in weights))
    here = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({f"in_{n}": F.sum(w).over(here) for n, w in weights.items()})
    same = (F.col("a.part") == F.col("b.part"),) + tuple(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by)
    both = rows.alias("a").join(parts.alias("b"), list(same))
    return both.select(*(F.col(f"a.{c}").alias(c) for c in df.columns), *((F.col(f"from_{n}") + F.col(f"in_{n}")).alias(n) for n in weights))
