"""Change data capture: from snapshots to changes, and from changes to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import RequestError
from .ranks import running


def capture(before: DataFrame, after: DataFrame, pk: list[str]) -> DataFrame:
    """(op, pk, old, new) of the rows that differ between two snapshots: Spark has no triggers."""
    image = lambda df, name: df.select(*pk, F.struct(*df.columns).alias(name))
    both = image(before, "old").join(image(after, "new"), pk, "full")
    op = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    return both.withColumn("op", op).where("op IS NOT NULL").select("op", *pk, "old", "new")


def poll(changes: DataFrame, cursor: int, n: int) -> DataFrame:
    """The next ``n`` changes after a watermark."""
    return changes.where(F.col("watermark") > cursor).orderBy("watermark").limit(n)


def check_watermarks(changes: DataFrame) -> None:
    """Watermarks must be distinct: an order is only strict then."""
    if not changes.groupBy("watermark").count().where("count > 1").isEmpty():
        raise RequestError("watermarks must increase strictly")


def steps(changes: DataFrame, pk: list[str], cursor: int) -> DataFrame:
    """Each change after the cursor as writes of single keys; an update that moves a key deletes the old one first."""
    fresh = changes.where(F.col("watermark") > cursor)
    new_key, old_key = F.struct(*(F.col(f"new.{c}").alias(c) for c in pk)), F.struct(*(F.col(f"old.{c}").alias(c) for c in pk))
    writes = fresh.where("op <> 'DELETE'").select("watermark", F.lit(1).alias("turn"), new_key.alias("key"), F.col("new").alias("row"))
    moved = (F.col("op") == "UPDATE") & F.col("old").isNotNull() & (old_key != new_key)
    drops = fresh.where((F.col("op") == "DELETE") | moved)
    return writes.unionByName(drops.select("watermark", F.lit(0).alias("turn"), old_key.alias("key"), F.lit(None).cast(fresh.schema["new"].dataType).alias("row")))


def apply(table: DataFrame, changes: DataFrame, pk: list[str], cursor: int = 0) -> DataFrame:
    """``table`` after the changes (watermark, op, old, new): the last write of each key wins.

    The last write is an aggregate (max_by), so a key with very many changes is summed up before the
    shuffle. Changes up to the cursor are skipped, so applying twice changes nothing."""
    known, got = set(table.columns), set(changes.schema["new"].dataType.names)
    if got - known:
        raise RequestError(f"schema refresh required: unknown columns {sorted(got - known)}", 409)
    if known - got:
        raise RequestError(f"the changes lack columns {sorted(known - got)}")
    last = steps(changes, pk, cursor).groupBy("key").agg(F.max_by(F.struct("row"), F.struct("watermark", "turn")).alias("last"))
    keys = last.select("key.*")
    written = last.where("last.row IS NOT NULL").select("last.row.*")
    return table.join(keys, pk, "left_anti").unionByName(written)


def touched(changes: DataFrame, pk: list[str]) -> DataFrame:
    """The keys that the changes touch, old and new."""
    return changes.select(F.explode(F.array("old", "new")).alias("row")).where("row IS NOT NULL").select(*(F.col(f"row.{c}").alias(c) for c in pk)).distinct()


def ledger_append(ledger: DataFrame, writes: DataFrame, rotate: int = 786_432, most: int = 1_048_576) -> DataFrame:
    """The ledger (version, row_table, row_pk, segment) with transactions (txn, row_table, row_pk) added in their order:
    each gets the next version and its keys once. A new segment begins whenever ``rotate`` bytes of keys are
    full; a transaction of over ``most`` bytes is refused, and all with it."""
    keys = writes.select("txn", "row_table", "row_pk").distinct()
    txns = keys.groupBy("txn").agg(F.sum(F.octet_length("row_table") + F.octet_length("row_pk")).alias("bytes"))
    if not txns.where(F.col("bytes") > most).isEmpty():
        raise RequestError("a transaction is too large for the ledger", 413)
    head = ledger.agg(F.max("version"), F.max("segment")).first()  # (None, None) where the ledger is empty
    numbered = running(txns.withColumn("one", F.lit(1)), [], ["txn"], nth="one", upto="bytes")
    segment = F.floor((F.col("upto") - F.col("bytes")) / rotate) + F.lit((head[1] if head[1] is not None else -1) + 1)
    numbered = numbered.select("txn", (F.col("nth") + F.lit(head[0] or 0)).cast("long").alias("version"), segment.cast("long").alias("segment"))
    return ledger.unionByName(keys.join(numbered, "txn").select("version", "row_table", "row_pk", "segment"))


def invalidate(ledger: DataFrame) -> tuple[DataFrame, int]:
    """The ledger with a reset mark as its next version, and that version as the floor: every client starts anew."""
    head = ledger.agg(F.max("version")).first()[0] or 0
    mark = ledger.sparkSession.createDataFrame([(head + 1,)], "version long").withColumns({c: F.lit(None).cast(ledger.schema[c].dataType) for c in ledger.columns if c != "version"})
    return ledger.unionByName(mark), head + 1


def ledger_scan(ledger: DataFrame, cookie: int) -> DataFrame:
    """(row_table, row_pk) touched by transactions after ``cookie``, each once."""
    return ledger.where((F.col("version") > cookie) & F.col("row_table").isNotNull()).select("row_table", "row_pk").distinct()


def ledger_gaps(ledger: DataFrame, cookie: int) -> DataFrame:
    """Versions after the cookie that don't follow on from the one before: a gap means a lost transaction."""
    versions = ledger.where(F.col("version") > cookie).select("version").distinct()
    before = versions.select((F.col("version") + 1).alias("version"))
    return versions.join(before, "version", "left_anti").where(F.col("version") != cookie + 1)


def retain(ledger: DataFrame, head: int, keep: int) -> tuple[DataFrame, int]:
    """The ledger's last ``keep`` versions, and the floor below which a client needs a whole snapshot."""
    floor = max(0, head - keep)
    return ledger.where(F.col("version") > floor), floor


class StagedSnapshot:
    """Pages of several tables, gathered aside and swapped in together once replay has caught up.

    The stages are plain DataFrames (or written tables); a new snapshot with another schema abandons the old."""

    def __init__(self, tables: dict[str, list[str]], schema: str):
        self.keys, self.schema, self.pages, self.watermark, self.done = tables, schema, {}, None, set()

    def add(self, table: str, page: DataFrame, schema: str, watermark: int, last: bool) -> None:
        if table not in self.keys:
            raise RequestError(f"unknown table {table!r}")
        if schema != self.schema:
            raise RequestError("schema refresh required", 409)
        if table in self.done:
            raise RequestError(f"{table} is complete")
        self.pages[table] = page if table not in self.pages else self.pages[table].unionByName(page)
        self.watermark = watermark if self.watermark is None else min(self.watermark, watermark)
        if last:
            self.done.add(table)

    def finish(self, changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """All tables with the changes since the first page replayed."""
        if self.done != set(self.keys):
            raise RequestError("the snapshot has tables without all pages")
        return {t: apply(rows, changes[t], self.keys[t], self.watermark) if t in changes else rows for t, rows in self.pages.items()}


def coalesce_changes(changes: DataFrame, pk: list[str]) -> DataFrame:
    """One change for each key: the first old image and the last new one."""
    return changes.groupBy(*pk).agg(F.max("watermark").alias("watermark"), F.min_by(F.struct("old"), "watermark")["old"].alias("old"), F.max_by(F.struct("new"), "watermark")["new"].alias("new"))
