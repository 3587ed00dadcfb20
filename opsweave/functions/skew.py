"""Plan shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.session import materialise, shuffle_partitions

MAX_BROADCAST_ROWS = 200_000


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    salts: int = 64,
    rows: int | None = None,
) -> DataFrame:
    """Join a large table to a per-key table without gathering a hot key in one task.

    ``dim`` should be materialised (counting it must be cheap).  Its row count, unless
    the caller has it already in ``rows``, is checked: a small one is broadcast, otherwise the join key is extended by a salt
    hashed from ``salt_by`` and the dim row is repeated once per salt.  The salted
    output is partitioned by (keys, salt), so a later groupBy cannot silently reuse
    a partitioning in which the hot key sits in one task.
    """
    if (dim.count() if rows is None else rows) <= max_broadcast_rows:
        return fact.join(F.broadcast(dim), list(keys), how)
    salted_fact = fact.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_fact.join(salted_dim, [*keys, "_salt"], how).drop("_salt")


def slice_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) and record each row's slice number as ``_slice``.

    The range bounds come from a sample, so a hot key is cut into many slices at its
    own quantiles.  The result is materialised: slice numbers then never change when
    a task is retried or the frame is read twice.
    """
    n = slices or shuffle_partitions(df.sparkSession)
    cut = df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id())
    return materialise(cut)


def running_total(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, out: str
) -> DataFrame:
    """Inclusive running sum of ``weight`` within keys, computed slice by slice.

    Inside a slice a window does the work; across slices only one number per
    (key, slice) is summed up.  Rows tied on ``order`` must already be merged.
    """
    weighted = sliced.withColumn("_w", weight)
    per_slice = weighted.groupBy(*keys, "_slice").agg(F.sum("_w").alias("_slice_sum"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(k) for k in keys], "_slice", F.coalesce(F.sum("_slice_sum").over(before), F.lit(0)).alias("_offset")
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = weighted.withColumn("_local", F.sum("_w").over(local))
    joined = running.join(offsets, [*keys, "_slice"])
    return joined.withColumn(out, F.col("_offset") + F.col("_local")).drop("_w", "_local", "_offset")
