"""Streaming feature windows, dedupe, sessions and late-signal handling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsweave.functions.numeric import severity_name, severity_rank
from opsweave.operators.correlate import CorrelationConfig
from opsweave.operators.features import SERIES_KEYS, FeatureConfig, _metric_aggregates


def dedupe_stream(obs: DataFrame, lateness: str) -> DataFrame:
    """First row per (event_id, metric_name) within the watermark; state expires with it."""
    return obs.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["event_id", "metric_name"])


def feature_windows(obs: DataFrame, cfg: FeatureConfig, lateness: str, series_keys: Sequence[str] = SERIES_KEYS, dedupe: bool = True) -> DataFrame:
    """Epoch-aligned feature windows of a stream (or batch), in append mode.

    Windows start at multiples of the step since the epoch.  Anchoring at the first
    event, filling empty windows and imputation look at a whole series and stay batch
    operators; run them on the table this query writes.
    """
    rows = dedupe_stream(obs, lateness) if dedupe else obs.withWatermark("event_time", lateness)
    window = F.window("event_time", f"{cfg.size_us} microseconds", f"{cfg.step_us} microseconds")
    aggs, reads = _metric_aggregates(cfg, exact_inline=True)
    grouped = rows.groupBy(*series_keys, window.alias("w")).agg(F.count(F.lit(1)).alias("sample_count"), *aggs)
    return grouped.select(
        *series_keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sample_count",
        *[reads[c].alias(c) for c in cfg.columns],
    )


def signal_sessions(signals: DataFrame, keys: Sequence[str], quiet_seconds: int, lateness: str) -> DataFrame:
    """Activity sessions per key, emitted once the watermark passes the quiet period."""
    rows = signals.withWatermark("event_time", lateness)
    session = F.session_window("event_time", f"{quiet_seconds} seconds")
    grouped = rows.groupBy(*keys, session.alias("s")).agg(
        F.min("event_time").alias("started_at"), F.max("event_time").alias("last_seen_at"), F.count(F.lit(1)).alias("signals"),
        F.max(severity_rank(F.col("severity"))).alias("_rank"),
    )
    return grouped.select(*keys, "started_at", "last_seen_at", "signals", severity_name(F.col("_rank")).alias("severity"))


def split_late(batch: DataFrame, watermark, cfg: CorrelationConfig) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a micro-batch by the late rule of the grouping.

    To be used in ``foreachBatch`` before any stateful operator, because a watermark
    drops late rows silently.  Under ``accept`` nothing is late; under ``delay`` the late
    rows belong in a side table that the next run reads again.
    """
    cutoff = F.unix_micros(F.lit(watermark).cast("timestamp")) - cfg.allowed_lateness_seconds * 1_000_000
    late = F.unix_micros("event_time") < cutoff
    if cfg.late == "accept":
        return batch, batch.where(F.lit(False))
    return batch.where(~late), batch.where(late)


INTAKE_SCHEMA = "signal_id string, semantic_fingerprint string, disposition string"


def intake(signals: DataFrame, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """Streaming dedupe by signal_id that also reports conflicts.

    Emits accepted for the first fingerprint of an id, duplicate for a repetition and
    conflict for another fingerprint.  The only state is one fingerprint per id, dropped
    ``ttl_ms`` after the last sighting (None keeps it; with a time limit the query keeps
    checking timeouts and does not stop by itself).  Needs signal_id and semantic_fingerprint.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None
        for pdf in batches:
            # Order inside a micro-batch is arbitrary; take the smallest new fingerprint first.
            prints = sorted(pdf["semantic_fingerprint"])
            said = []
            for p in prints:
                if known is None:
                    known = p
                    said.append("accepted")
                else:
                    said.append("duplicate" if p == known else "conflict")
            yield pd.DataFrame({"signal_id": key[0], "semantic_fingerprint": prints, "disposition": said})
        if known is not None:
            state.update((known,))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return signals.select("signal_id", "semantic_fingerprint").groupBy("signal_id").applyInPandasWithState(
        step, INTAKE_SCHEMA, "fingerprint string", "append", timeout
    )
