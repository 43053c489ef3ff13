"""Checks over event histories, as windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Events of a task, so that its memory doesn't grow with the history.
ROWS = 1 << 17


def spread(events: DataFrame, n: int, by: str) -> DataFrame:
    """``events`` (``n`` rows) dealt by a column to a number of partitions that grows with them."""
    return events.repartition(-(-n // ROWS) or 1, by)


def validate(events: DataFrame) -> DataFrame:
    """(index, problem) of a history (index, time, process, type, kind): indexes are dense from 0, times don't
    fall, a process has one operation open at most, and each invoke ends in one ok, fail or info of its kind."""
    n = events.count()
    return order_problems(events, n).unionByName(operation_problems(spread(events, n, "process")))


def order_problems(events: DataFrame, n: int) -> DataFrame:
    """(index, problem) of ``n`` events (index, time)."""
    # dense indexes make the order checks local: each event meets its predecessor by an equi-join, not in one task
    before = spread(events.select((F.col("index") + 1).alias("index"), F.col("time").alias("before")), n, "index")
    paired = spread(events.select("index", "time"), n, "index").join(before.hint("merge"), "index", "left")
    problem = F.when(F.col("before").isNull() & (F.col("index") != 0), "gap in indexes").when(F.col("time") < F.col("before"), "time goes back")
    same = Window.partitionBy("index").orderBy("index")
    twice = spread(events.select("index"), n, "index").withColumn("nth", F.row_number().over(same)).where("nth = 2")
    return paired.select("index", problem.alias("problem")).where("problem IS NOT NULL").unionByName(twice.select("index", F.lit("index repeats").alias("problem")))


def operation_problems(events: DataFrame) -> DataFrame:
    """(index, problem) of events (index, process, type, kind), dealt by process."""
    own = Window.partitionBy("process").orderBy("index")
    steps = events.withColumns({"was": F.lag("type").over(own), "was_kind": F.lag("kind").over(own), "next": F.lead("type").over(own)})
    ends = F.col("type") != "invoke"
    problem = (
        F.when(~ends & (F.col("was") == "invoke"), "invoke while another is open")
        .when(ends & (F.col("was").isNull() | (F.col("was") != "invoke")), "end without an invoke")
        .when(ends & (F.col("was_kind") != F.col("kind")), "end of another kind")
    )
    open_ = F.when(~ends & (F.col("next").isNull() | (F.col("next") == "invoke")), "invoke without an end")
    return steps.select("index", F.explode(F.array(open_, problem)).alias("problem")).where("problem IS NOT NULL")


def monotonic(snapshots: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The snapshots whose value is below the one before in their group, with that one."""
    w = Window.partitionBy(*by).orderBy(order)
    return snapshots.withColumn("before", F.lag(value).over(w)).where(F.col(value) < F.col("before")).select(*by, order, "before", value)


def atomic_visibility(effects: DataFrame, reads: DataFrame) -> DataFrame:
    """(group, read, seen, effects) of reads that cover all keys of a group and show some of its effects only.

    ``effects``: (group, key, version); ``reads``: (read, key, version), version NULL where the key was absent."""
    size = effects.groupBy("group").agg(F.count("*").alias("effects"))
    met = effects.join(reads.select("read", "key", F.col("version").alias("seen_version")), "key")
    counts = met.groupBy("group", "read").agg(F.count("*").alias("covered"), F.sum(F.coalesce(F.col("seen_version") >= F.col("version"), F.lit(False)).cast("long")).alias("seen"))
    return counts.join(size, "group").where("covered = effects AND seen > 0 AND seen < effects").select("group", "read", "seen", "effects")


def exactly_once(pushes: DataFrame, finals: DataFrame) -> DataFrame:
    """(client, problem): an acknowledged mutation was applied never or twice, or the last id is not the largest."""
    per = pushes.groupBy("client", "id").agg(F.sum(F.col("applied").cast("long")).alias("times"), F.max(F.col("acked").cast("int")).alias("acked"))
    lost = per.where("acked = 1 AND times = 0").select("client", F.lit("acknowledged and not applied").alias("problem"))
    twice = per.where("times > 1").select("client", F.lit("applied twice").alias("problem"))
    top = per.where("times > 0").groupBy("client").agg(F.max("id").alias("top"))
    wrong = finals.join(top, "client", "left").where("last_id <> coalesce(top, 0)").select("client", F.lit("last id differs").alias("problem"))
    return lost.unionByName(twice).unionByName(wrong).distinct()


def permission_leaks(reads: DataFrame, grants: DataFrame) -> DataFrame:
    """Reads (client, key, version) of a key outside all of the client's grant intervals [since, until)."""
    on = (reads.client == grants.client) & (reads.key == grants.key) & (reads.version >= grants.since) & (grants.until.isNull() | (reads.version < grants.until))
    return reads.join(grants, on, "left_anti")


def append_lists(events: DataFrame) -> DataFrame:
    """(key, values): each key's appended values in order of time, as list-append checkers read them."""
    packed = F.array_sort(F.collect_list(F.struct("index", "value")))
    return events.where("kind = 'append' AND type = 'ok'").groupBy("key").agg(F.transform(packed, lambda x: x["value"]).alias("values"))
