"""What the operators of this package share: reading, shared folders, size-checked joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsweave.session import ensure_checkpoint_dir, materialise, prepare

# The contracts' white space: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Rows that a Python task is handed at a time.  The JVM and the worker both hold a batch of texts.
BATCH_ROWS = 1000

# A joined side is broadcast up to this many rows of a few fixed-width columns
# (some 30 MB as a hashed table), and shuffled beyond.
BROADCAST_ROWS = 200_000


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in batches of at most ``BATCH_ROWS``; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the one that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{what}-{uuid.uuid4().hex}"


def fingerprint(text: Column | str = "text") -> Column:
    """Tells texts of one doc_id apart; equal for rows that repeat each other."""
    return F.xxhash64(text)


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a materialised table for broadcast if its counted size allows it.

    Beyond the bound the join shuffles both sides and adaptive execution splits hot keys.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Run the plan once; later steps read its reliable checkpoint."""
    return materialise(df)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also where lambdas use it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
