"""Parquet tables with UTC timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opsweave.session import prepare


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``folder/name.parquet``; zone-less timestamps are taken as UTC instants."""
    prepare(spark)
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    naive = {f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return df.select([F.col(c).cast("timestamp").alias(c) if c in naive else F.col(c) for c in df.columns])
