"""Field streams: text that grows or values that replace each other, keyed by topic and generation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.catalog import Catalog, RequestError


def validate_manifest(manifest: list[dict], catalog: Catalog) -> None:
    """Each streamed field: a non-key column of a declared table; append for strings only, a check for JSON, a positive bound."""
    seen = set()
    for f in manifest:
        spec = catalog.spec(f["table"])
        kind = spec.columns.get(f["column"])
        if kind is None or f["column"] in spec.primary_key or (f["table"], f["column"]) in seen:
            raise RequestError(f"{f['table']}.{f['column']} can't be streamed")
        seen.add((f["table"], f["column"]))
        if f.get("mode") not in ("append", "replace") or (f["mode"] == "append" and kind != "string"):
            raise RequestError(f"{f['column']}: append takes a string column")
        if kind == "json" and not callable(f.get("validate")):
            raise RequestError(f"{f['column']}: a json field needs a check")
        if not isinstance(f.get("max_bytes"), int) or f["max_bytes"] <= 0:
            raise RequestError(f"{f['column']}: the bound must be positive")


def accumulate(frames: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(topic, stream, mode, value, seq, ended) of each topic's last generation, from frames
    (topic, stream, started, seq, mode, value, ended): the latest started generation supersedes all others,
    a repeated seq counts once, appends are joined in order, of replacements the last stays."""
    last = frames.groupBy("topic").agg(F.max_by("stream", F.struct("started", "stream")).alias("stream"))
    live = frames.join(last, ["topic", "stream"]).dropDuplicates(["topic", "stream", "seq"])
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    text = F.array_join(F.transform(parts, lambda x: F.coalesce(x["value"], F.lit(""))), "")
    out = live.groupBy("topic", "stream").agg(
        F.first("mode").alias("mode"), text.alias("text"), F.max_by("value", "seq").alias("latest"), F.max("seq").alias("seq"), F.max(F.coalesce("ended", F.lit(False))).alias("ended")
    )
    value = F.when(F.col("mode") == "append", F.col("text")).otherwise(F.col("latest"))
    out = out.select("topic", "stream", "mode", value.alias("value"), "seq", "ended")
    return out if max_bytes is None else out.where(F.octet_length("value") <= max_bytes)


def admitted(frames: DataFrame, manifest: list[dict]) -> DataFrame:
    """The frames (table, column, value, ...) whose field's checks hold: ``filter`` and ``validate`` are functions from
    the value's column to a condition. Frames of fields that the manifest lacks go."""
    keep = F.lit(False)
    for f in manifest:
        mine = (F.col("table") == f["table"]) & (F.col("column") == f["column"])
        checks = [f[k](F.col("value")) for k in ("filter", "validate") if callable(f.get(k))]
        keep = keep | reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), checks, mine)
    return frames.where(keep)


def paced(values: DataFrame, max_updates: int, max_bytes: int) -> DataFrame:
    """What a publisher sends of (topic, at, value): in each second at most ``max_updates`` values, the last of each of as
    many even slots, and of these as many from the first on as fit into ``max_bytes``. A publisher starts anew each second."""
    slots = coalesced(values, 1000 / max_updates)
    second = Window.partitionBy("topic", F.floor(F.col("at") / 1000)).orderBy("flush")  # at most max_updates rows
    return slots.withColumn("bytes", F.sum(F.octet_length("value")).over(second)).where(F.col("bytes") <= max_bytes).select("topic", "at", "value")


def suffixes(values: DataFrame) -> DataFrame:
    """What a publisher ships of a growing value (topic, seq, value): the part after the delivered prefix;
    ``broken`` where the value doesn't keep that prefix."""
    before = F.coalesce(F.lag("value").over(Window.partitionBy("topic").orderBy("seq")), F.lit(""))
    rows = values.withColumn("before", before)
    keeps = F.substring("value", 1, F.length("before")) == F.col("before")
    return rows.select("topic", "seq", F.when(keeps, F.expr("substring(value, length(before) + 1)")).alias("suffix"), (~keeps).alias("broken"))


def coalesced(values: DataFrame, window_ms: float, order: str = "at") -> DataFrame:
    """The last value (by ``order``) of each topic in each flush window (topic, at, value)."""
    return values.groupBy("topic", F.floor(F.col("at") / window_ms).alias("flush")).agg(F.max("at").alias("at"), F.max_by("value", order).alias("value"))


STATE = "stream string, started long, seq long, value string, ended boolean"
OUT = "topic string, stream string, seq long, value string, ended boolean, rejected long"


def step(mode: str, max_bytes: int | None):
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stream, started, seq, value, ended = state.get if state.exists else (None, -1, -1, "", False)
        parts, size, rejected = [value], len((value or "").encode()), 0
        # Spark cuts a topic's rows into frames in any order: all of a micro-batch are sorted together
        for r in pd.concat(list(frames)).sort_values(["started", "seq"]).itertuples(index=False):
            if r.stream != stream and r.started > started:
                stream, started, seq, parts, size, ended = r.stream, r.started, -1, [""], 0, False
            longer = len((r.value or "").encode()) + (size if mode == "append" else 0)
            if r.stream != stream or r.seq <= seq or ended or (max_bytes is not None and longer > max_bytes):
                rejected += 1
                continue
            parts = parts if mode == "append" else []
            parts.append(r.value or "" if mode == "append" else r.value)
            seq, size, ended = r.seq, longer, bool(r.ended)
        value = "".join(parts) if mode == "append" else parts[0]
        state.update((stream, int(started), int(seq), value, ended))
        yield pd.DataFrame([(key[0], stream, int(seq), value, ended, rejected)], columns=["topic", "stream", "seq", "value", "ended", "rejected"])

    return fold


def live_fields(frames: DataFrame, mode: str = "append", max_bytes: int | None = 1 << 20) -> DataFrame:
    """The streaming form: each topic's state after each batch. Stale generations, repeated or falling
    sequence numbers, frames after the end and values over ``max_bytes`` are rejected and counted;
    within a micro-batch the order of the rows doesn't matter. Without ``max_bytes`` no value is too long."""
    return frames.groupBy("topic").applyInPandasWithState(step(mode, max_bytes), OUT, STATE, "update", GroupStateTimeout.NoTimeout)
