"""Queries over stored telemetry: metric selectors, instant and range queries, evidence search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.functions.text import METRIC_NAME
from opsweave.operators.ingest import MAX_UINT64

LOOKBACK_SECONDS = 300.0
SERIES = ("metric", "service", "tenant_id", "environment", "run_id", "seed")
_LABELS = ("service", "tenant_id", "environment", "run_id", "seed", "event_id")


def _micros(ts) -> Column:
    return F.unix_micros(ts if isinstance(ts, Column) else F.lit(ts).cast("timestamp"))


def _check_range(start, end) -> None:
    if start is not None and end is not None and not isinstance(start, Column) and not isinstance(end, Column) and str(start) > str(end):
        raise ValueError("start must not be after end")


def select_metric(samples: DataFrame, metric: str, start=None, end=None, **labels) -> DataFrame:
    """Samples of one metric with equal labels in the closed range, by (timestamp, event_id)."""
    if not re.match(METRIC_NAME, metric.strip()):
        raise ValueError(f"invalid metric name {metric!r}")
    unknown = set(labels) - set(_LABELS)
    if unknown:
        raise ValueError(f"unknown labels {sorted(unknown)}")
    seed = labels.get("seed")
    if seed is not None and not 0 <= int(seed) <= int(MAX_UINT64):
        raise ValueError("seed must be in the unsigned 64-bit range")
    _check_range(start, end)
    rows = samples.where(F.col("metric") == metric.strip())
    for name, value in labels.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    return rows


def metric_query(samples: DataFrame, metric: str, start=None, end=None, **labels) -> DataFrame:
    return select_metric(samples, metric, start, end, **labels).orderBy("timestamp", "event_id")


def instant_query(samples: DataFrame, metric: str, at, series: Sequence[str] = SERIES, lookback_seconds: float = LOOKBACK_SECONDS, **labels) -> DataFrame:
    """Last value per series in (at - lookback, at]; ties by the larger event id."""
    back = int(lookback_seconds * 1_000_000)
    t = F.unix_micros("timestamp")
    rows = select_metric(samples, metric, **labels).where(
        (F.col("timestamp") <= F.lit(at).cast("timestamp")) & (F.col("timestamp") > F.timestamp_micros(_micros(at) - back))
    )
    order = F.struct(t, F.col("event_id"))
    return rows.groupBy(*series).agg(
        F.max_by("value", order).alias("value"), F.max("timestamp").alias("sample_time")
    ).withColumn("timestamp", F.lit(at).cast("timestamp"))


def range_query(samples: DataFrame, metric: str, start, end, step_seconds: float = 1.0, series: Sequence[str] = SERIES,
                lookback_seconds: float = LOOKBACK_SECONDS, **labels) -> DataFrame:
    """Value of every series at start, start+step, ... up to end: the last sample in the lookback.

    First only the latest sample per (series, step) survives, in one partially aggregated
    pass; a sample then answers the grid points until the next one or until it is stale.
    Neither the raw rows of a busy series nor the full grid are ever gathered.
    """
    if step_seconds <= 0:
        raise ValueError("step must be positive")
    _check_range(start, end)
    step, back = int(step_seconds * 1_000_000), int(lookback_seconds * 1_000_000)
    t0, t1 = _micros(start), _micros(end)
    t = F.unix_micros("timestamp")
    rows = select_metric(samples, metric, **labels).where(
        (F.col("timestamp") <= F.lit(end).cast("timestamp")) & (F.col("timestamp") > F.timestamp_micros(t0 - back))
    )
    # Grid point at which a sample is seen first: ceil((t - start) / step), not before 0.
    placed = rows.withColumn("_t", t).withColumn("_t0", t0).withColumn("_end", t1)
    cell = F.expr(f"if(_t <= _t0, 0L, (_t - _t0 + {step - 1}L) div {step}L)")
    latest = placed.withColumn("_cell", cell).groupBy(*series, "_cell").agg(
        F.max_by("value", F.struct("_t", "event_id")).alias("value"), F.max("_t").alias("_t"), F.min("_t0").alias("_t0"), F.min("_end").alias("_end")
    )
    order = Window.partitionBy(*series).orderBy("_cell")
    until = F.least(
        F.coalesce(F.lead("_cell").over(order) - 1, F.lit(2**62)),
        F.expr(f"(_t + {back - 1}L - _t0) div {step}L"),
        F.expr(f"(_end - _t0) div {step}L"),
    )
    spans = latest.withColumn("_until", until).where(F.col("_cell") <= F.col("_until"))
    points = spans.withColumn("_g", F.explode(F.sequence("_cell", "_until")))
    return points.select(*series, F.timestamp_micros(F.col("_t0") + F.col("_g") * step).alias("timestamp"), "value", F.timestamp_micros("_t").alias("sample_time"))


def evidence_query(evidence: DataFrame, limit: int | None = None, start=None, end=None, marker: str | None = None, **terms) -> DataFrame:
    """Evidence matching all terms in the closed time range, by (event_time, event_id): all, or the earliest ``limit``."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    unknown = set(terms) - {"run_id", "seed", "service", "event_type", "severity", "trace_id", "event_id"}
    if unknown:
        raise ValueError(f"unknown terms {sorted(unknown)}")
    if terms.get("event_type") not in (None, "log", "system"):
        raise ValueError("event_type must be log or system")
    _check_range(start, end)
    rows = evidence.where(F.col("event_type").isin("log", "system"))
    for name, value in terms.items():
        if isinstance(value, str) and not value.strip():
            raise ValueError(f"{name} must not be empty")
        if value is not None:
            rows = rows.where(F.col(name) == (str(value) if name == "seed" else value))
    if marker is not None:
        rows = rows.where(F.col("marker") == marker)
    if start is not None:
        rows = rows.where(F.col("event_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("event_time") <= F.lit(end).cast("timestamp"))
    ordered = rows.orderBy("event_time", "event_id")
    return ordered if limit is None else ordered.limit(limit)
