"""Exact interpolated quantiles that survive a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opsweave.functions.skew import running_total, slice_by_order
from opsweave.session import materialise

HOT_ROWS = 5_000_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Sequence[float],
    out: str = "quantiles",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per key with ``out ARRAY<DOUBLE>``: linear interpolation on (n-1)*q.

    Nulls are ignored.  Spark's ``percentile`` keeps every distinct value of a group
    in one buffer, which is fine up to ``hot_rows`` rows; larger groups are ranked
    by ``sliced_quantiles``.  Group sizes come from one counting pass.
    """
    rows = df.where(F.col(value).isNotNull())
    keys = list(keys)
    sizes = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    hot = sizes.where(F.col("_n") > hot_rows).select(*keys)
    builtin = F.percentile(F.col(value), [float(q) for q in quantiles]).alias(out)
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= hot_rows:
        return rows.groupBy(*keys).agg(builtin)
    if not keys:
        return sliced_quantiles(rows, keys, value, quantiles, out)
    # At most total/hot_rows groups are hot, so the list of hot keys is tiny.
    cold_part = rows.join(F.broadcast(hot), keys, "left_anti").groupBy(*keys).agg(builtin)
    hot_part = sliced_quantiles(rows.join(F.broadcast(hot), keys, "left_semi"), keys, value, quantiles, out)
    return cold_part.unionByName(hot_part)


def sliced_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], out: str = "quantiles"
) -> DataFrame:
    """The same result by distributed ranking: no task ever holds a whole group."""
    keys = list(keys)
    tag = []
    if not keys:
        df, keys, tag = df.withColumn("_all", F.lit(0)), ["_all"], ["_all"]
    merged = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(slice_by_order(merged, keys, [value]), keys, [value], F.col("_n"), "_upto")
    totals = ranked.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = ranked.join(totals, keys)
    picks = []
    for i, q in enumerate(quantiles):
        rank = F.lit(float(q)) * (F.col("_total") - 1)
        for side, pos in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            holds = (F.col("_upto") - F.col("_n") <= pos) & (pos < F.col("_upto"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"_{side}{i}"))
    picked = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    parts = []
    for i, q in enumerate(quantiles):
        rank = F.lit(float(q)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        step = rank - F.floor(rank)
        parts.append(F.when(lo == hi, lo).otherwise((1 - step) * lo + step * hi).cast("double"))
    return picked.select(*[k for k in keys if k not in tag], F.array(*parts).alias(out))
