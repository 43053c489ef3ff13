"""Sinks: backups of all declared tables, and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalog import Catalog


def backup(catalog: Catalog, path: str) -> None:
    """Write every bound table, then the manifest that makes the backup whole."""
    spark = None
    rows = []
    for name in catalog.frames:
        df = catalog.scan(name)
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, df.schema.json()))
    if spark is not None:
        spark.createDataFrame(rows, "name string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from pyspark.sql.types import StructType
    import json

    manifest = spark.read.parquet(f"{path}/manifest").collect()  # one row for each table
    return {r.name: spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(f"{path}/{r.name}") for r in manifest}


def write_patch(patch: DataFrame, path: str, version: int) -> None:
    """Append a row patch (op, table_name, id, value) under its version."""
    patch.write.mode("overwrite").parquet(f"{path}/version={version}")
