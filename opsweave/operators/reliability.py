"""Pipeline health: run summary, percentiles, lag, reconciliation, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.operators.quantiles import HOT_ROWS, exact_quantiles


def percentile_or_zero(values: Column, percent: float) -> Column:
    """Linear percentile 0-100; 0.0 for no values."""
    return F.coalesce(F.percentile(values, percent / 100.0), F.lit(0.0))


def percentiles_or_zero(rows: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float]) -> DataFrame:
    """``q``: linear percentiles 0-100 per key, 0.0 for a key without values; large groups are ranked in slices."""
    ranked = exact_quantiles(rows, keys, value, [p / 100.0 for p in percents], "q")
    none = F.array(*[F.lit(0.0)] * len(percents))
    return rows.select(*keys).distinct().join(ranked, list(keys), "left").select(*keys, F.coalesce("q", none).alias("q"))


def end_to_end_ms(now_ms: Column, broker_ms: Column) -> Column:
    """max(0, now - broker time); null without a broker time."""
    return F.when(broker_ms > 0, F.greatest(F.lit(0.0), (now_ms - broker_ms).cast("double")))


def consumer_lag(ends: DataFrame, committed: DataFrame, keys: Sequence[str] = ("topic", "partition")) -> DataFrame:
    """max(0, end - committed) per partition; nothing committed counts as 0."""
    joined = ends.join(committed, list(keys), "left")
    return joined.select(*keys, F.greatest(F.lit(0), F.col("end_offset") - F.coalesce("committed_offset", F.lit(0))).cast("bigint").alias("lag"))


def pipeline_summary(operations: DataFrame, elapsed_seconds: Column | float, sample_window: int | None = None) -> DataFrame:
    """One row of counters and latencies.

    ``operations``: kind (publish, persist, quarantine, failure), seq (order), latency_ms,
    retries, e2e_ms.  A quarantine also counts as failed.  Percentiles are over all
    latencies, ranked in slices; with ``sample_window``, over that many newest of each sort.
    """
    retries = F.when((F.col("kind") == "persist") & (F.col("retries") > 0), F.col("retries"))
    counts = operations.agg(
        F.count_if(F.col("kind") == "publish").alias("published_count"),
        F.count_if(F.col("kind") == "persist").alias("persisted_count"),
        F.count_if(F.col("kind") == "quarantine").alias("quarantined_count"),
        F.count_if(F.col("kind").isin("quarantine", "failure")).alias("failed_count"),
        F.coalesce(F.sum(retries), F.lit(0)).alias("retry_count"),
    )
    sorts = F.filter(
        F.array(
            F.when(F.col("kind") == "publish", F.struct(F.lit("publish").alias("sort"), F.col("latency_ms").alias("ms"))),
            F.when(F.col("kind") == "persist", F.struct(F.lit("persistence").alias("sort"), F.col("latency_ms").alias("ms"))),
            F.when(F.col("kind") == "persist", F.struct(F.lit("e2e").alias("sort"), F.col("e2e_ms").alias("ms"))),
        ),
        lambda s: s.isNotNull() & (s["ms"] >= 0),
    )
    long = operations.select("seq", F.explode(sorts).alias("s")).select("seq", "s.sort", "s.ms")
    if sample_window is not None:
        newest = Window.partitionBy("sort").orderBy(F.col("seq").desc())
        long = long.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= sample_window)
    ranked = exact_quantiles(long, ["sort"], "ms", [0.5, 0.99], "q")
    marks = ranked.agg(*[
        F.round(F.coalesce(F.max(F.when(F.col("sort") == s, F.col("q")[i])), F.lit(0.0)), 3).alias(f"{s}_latency_p{p}_ms")
        for s in ("publish", "persistence", "e2e") for i, p in enumerate((50, 99))
    ])
    span = F.greatest(F.lit(0.001), elapsed_seconds if isinstance(elapsed_seconds, Column) else F.lit(float(elapsed_seconds)))
    throughput = F.round((F.col("persisted_count") + F.col("quarantined_count")) / span, 2)
    return counts.withColumn("throughput_per_second", throughput).crossJoin(marks)  # one row each


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids in only one of two stores: (key, problem) with problem missing or unexpected."""
    want, have = expected.select(key).distinct(), actual.select(key).distinct()
    return want.join(have, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(
        have.join(want, key, "left_anti").withColumn("problem", F.lit("unexpected"))
    )


def rollup(operations: DataFrame, keys: Sequence[str], latency: str = "latency_ms", hot_rows: int = HOT_ROWS) -> DataFrame:
    """count, mean, p50, p95 and max latency per stage, status or any other context keys."""
    plain = operations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("operations"), F.avg(latency).alias("mean_ms"), F.max(latency).alias("max_ms")
    )
    marks = exact_quantiles(operations, list(keys), latency, [0.5, 0.95], "_q", hot_rows)
    cond = [plain[k].eqNullSafe(marks[k]) for k in keys]
    return plain.join(marks, cond, "left").select(
        *[plain[k] for k in keys], "operations", "mean_ms", "max_ms", F.col("_q")[0].alias("p50_ms"), F.col("_q")[1].alias("p95_ms")
    )
