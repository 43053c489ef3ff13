"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may go without one that is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="karstflow-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/karstflow-{spark.sparkContext.applicationId}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there,
    so a lost executor costs a reread and not the jobs before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch on its way to Python; a single longer row travels alone.
BATCH_BYTES = 8 << 20


def byte_batches(spark: SparkSession) -> None:
    """Batches are bounded by their bytes, long texts or not. All operators set the one value, so whatever
    is planned now and run later finds it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Rows up to which a side may be broadcast; the callers count first and join by shuffle beyond it.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast where the counted size allows it; any larger side is shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fold(doc_id, parts: int = 5):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
