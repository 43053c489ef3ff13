"""Change ingestion as a stream: each micro-batch is applied to a versioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import cdc


LOG = "version long, cursor long, bucket int, filled boolean"


class VersionedTable:
    """A table in ``buckets`` folders by key hash, each with its versions, and a log of (version, cursor, bucket,
    filled): a version is written first and takes effect with its log entries, so a batch applied twice, or half,
    changes nothing. A version holds only the buckets that its changes touch. Every read and write goes through
    Spark, whatever the store."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, pk: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.pk, self.buckets = spark, path.rstrip("/"), schema, pk, buckets

    def create(self, rows: DataFrame) -> None:
        self._commit(rows, 0, 0, list(range(self.buckets)))

    def _bucket(self, prefix: str = "") -> Column:
        return F.pmod(F.xxhash64(*(F.col(prefix + c) for c in self.pk)), F.lit(self.buckets)).cast("int")

    def _commit(self, rows: DataFrame, version: int, cursor: int, touched: list[int]) -> None:
        schema = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        path = f"{self.path}/v{version}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        filled = {r.bucket for r in self.spark.read.schema(schema).parquet(path).select("bucket").distinct().collect()}  # one for each bucket at most
        entries = self.spark.createDataFrame([(version, cursor, b, b in filled) for b in touched], LOG)
        entries.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def head(self) -> tuple[int, int]:
        row = self.log().agg(F.max(F.struct("version", "cursor")).alias("h")).first()
        return row.h.version, row.h.cursor

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest version of all or some buckets."""
        last = self.log().groupBy("bucket").agg(F.max_by("filled", "version").alias("filled"), F.max("version").alias("version")).where("filled")
        paths = [f"{self.path}/v{r.version}/bucket={r.bucket}" for r in last.collect() if buckets is None or r.bucket in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, changes: DataFrame) -> None:
        version, cursor = self.head()
        fresh = changes.where(F.col("watermark") > cursor)
        keys = fresh.select(F.explode(F.array("old", "new")).alias("row")).where("row IS NOT NULL")
        touched = sorted(r.bucket for r in keys.select(self._bucket("row.").alias("bucket")).distinct().collect())
        top = fresh.agg(F.max("watermark")).first()[0]
        if touched:
            self._commit(cdc.apply(self.read(touched), fresh, self.pk, cursor), version + 1, top, touched)

    def purge(self) -> int:
        """Delete the folders that newer ones have replaced, once readers of them are done; how many went."""
        newest = Window.partitionBy("bucket").orderBy(F.desc("version"))
        old = self.log().withColumn("n", F.row_number().over(newest)).where("n > 1 AND filled").select("version", "bucket").collect()
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        gone = 0
        for r in old:
            path = hadoop(f"{self.path}/v{r.version}/bucket={r.bucket}")
            gone += bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True))
        return gone


def ingest(changes: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes until its source is drained; restarting goes on from the checkpoint."""
    return changes.writeStream.foreachBatch(lambda batch, _: table.apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
