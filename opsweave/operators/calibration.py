"""Score calibration: empirical CDF per model, leakage guards and severity bands."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.functions.numeric import CALIBRATED_BANDS, clamp, is_finite, severity_from_score
from opsweave.functions.skew import lookup_join, slice_by_order
from opsweave.session import materialise

MODEL_KEYS = ("model_name", "model_version")
# Reference tables up to this many distinct scores travel to the tasks as sorted arrays.
MAX_INLINE_SCORES = 1_000_000

# Raw score kind and direction of each detector.
RAW_SCORES = {
    "forecast": ("forecast_absolute_deviation", "higher_is_more_anomalous"),
    "isolation_forest": ("score_samples", "lower_is_more_anomalous"),
    "reconstruction": ("reconstruction_error", "higher_is_more_anomalous"),
}


@dataclass(frozen=True)
class CalibrationConfig:
    method: str = "empirical_cdf_percentile"
    min_samples: int = 10
    supported_models: tuple[str, ...] | None = ("forecast", "isolation_forest", "reconstruction")
    degenerate: str = "center_or_zero"
    bands: tuple[tuple[str, float], ...] = CALIBRATED_BANDS
    max_inline_scores: int = MAX_INLINE_SCORES

    def __post_init__(self) -> None:
        if self.method not in ("empirical_cdf_percentile", "identity"):
            raise ValueError(f"unknown calibration method {self.method!r}")
        if self.min_samples < 3:
            raise ValueError("min_samples must be at least 3")
        if self.degenerate not in ("center_or_zero", "error"):
            raise ValueError("degenerate must be center_or_zero or error")


def _supported(cfg: CalibrationConfig) -> Column:
    if cfg.supported_models is None:
        return F.lit(True)
    return F.col("model_name").isin(*cfg.supported_models)


def reference_report(reference: DataFrame, cfg: CalibrationConfig, cutoff=None) -> DataFrame:
    """One row per (model, version) with the fit and the first reason to refuse it.

    ``reference`` has sample_id, model_name, model_version, score, event_time and
    partition_role.  Order of checks: supported model, enough samples, every score a number
    in [0, 1], every sample of role ``calibration``, no sample after the cutoff (on the cutoff is allowed).
    """
    late = F.lit(False) if cutoff is None else F.col("event_time") > F.lit(cutoff).cast("timestamp")
    fit = reference.groupBy(*MODEL_KEYS).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        F.min("event_time").alias("earliest"),
        F.max("event_time").alias("latest"),
        F.count_if(F.col("partition_role") != "calibration").alias("foreign_samples"),
        F.count_if(late).alias("late_samples"),
        F.count_if(~F.coalesce(is_finite(F.col("score")) & F.col("score").between(0.0, 1.0), F.lit(False))).alias("unusable_samples"),
    )
    verdict = (
        F.when(~_supported(cfg), "unsupported_model")
        .when(F.col("sample_count") < cfg.min_samples, "insufficient_reference_data")
        .when(F.col("unusable_samples") > 0, "invalid_reference_score")
        .when(F.col("foreign_samples") > 0, "leakage_partition_role")
        .when(F.col("late_samples") > 0, "leakage_after_cutoff")
        .otherwise("fitted")
    )
    return fit.withColumn("is_degenerate", F.col("low") == F.col("high")).withColumn("verdict", verdict)


def fit_calibration(reference: DataFrame, cfg: CalibrationConfig, cutoff=None, strict: bool = True) -> DataFrame:
    """Fitted rows of the report.  With ``strict`` any refused model stops the run."""
    report = materialise(reference_report(reference, cfg, cutoff))
    if strict:
        refused = report.where("verdict <> 'fitted'").select(*MODEL_KEYS, "verdict").take(1)
        if refused:
            raise ValueError(f"calibration reference refused: {refused[0].asDict()}")
    return report.where("verdict = 'fitted'")


def reference_steps(reference: DataFrame) -> DataFrame:
    """Distinct reference scores with their rank and neighbours, built slice by slice.

    Columns: score, n (ties), below (samples under it), prev, next.
    """
    keys = list(MODEL_KEYS)
    merged = reference.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))
    sliced = slice_by_order(merged, keys, ["score"])
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum("n").alias("_sum"), F.max("score").alias("_hi"), F.min("score").alias("_lo"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    edges = per_slice.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        F.max("_hi").over(before).alias("_before"),
        F.min("_lo").over(after).alias("_after"),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("score")
    local = sliced.withColumn("_upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn("_prev", F.lag("score").over(inside)).withColumn("_next", F.lead("score").over(inside))
    return local.join(edges, [*keys, "_slice"]).select(
        *keys,
        "score",
        "n",
        (F.col("_offset") + F.col("_upto") - F.col("n")).alias("below"),
        F.coalesce("_prev", "_before").alias("prev"),
        F.coalesce("_next", "_after").alias("next"),
    )


def _floor_step_sliced(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds ``step``: the last reference step at or below each score, by a range-sliced scan.

    Tied scores are ordered by a hash, so even one very common score spreads over slices.
    """
    keys = list(MODEL_KEYS)
    tie = F.xxhash64("source_signal_id")
    tagged = rows.withColumn("_row", F.struct(*rows.columns)).select(
        *keys, "score", F.lit(1).alias("_kind"), tie.alias("_tie"), "_row", F.lit(None).cast("double").alias("_none")
    )
    step = F.struct(F.col("score"), F.col("n"), F.col("below"), F.col("prev"), F.col("next"))
    refs = steps.select(*keys, "score", F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"), step.alias("_step"))
    both = tagged.drop("_none").unionByName(refs, allowMissingColumns=True)
    order = ["score", "_kind", "_tie"]
    sliced = slice_by_order(both, keys, order)
    last_in_slice = sliced.where("_step IS NOT NULL").groupBy(*keys, "_slice").agg(F.max_by("_step", "score").alias("_end"))
    slices = sliced.select(*keys, "_slice").distinct().join(last_in_slice, [*keys, "_slice"], "left")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_local", F.last("_step", ignorenulls=True).over(inside)).where("_kind = 1")
    return local.join(carry, [*keys, "_slice"]).select(
        "_row.*", F.coalesce("_local", "_carry").alias("step")
    )


def _floor_step_inline(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """The same lookup without a shuffle of the scores: sorted arrays and binary search."""
    table = {}
    for key, part in steps.toPandas().groupby(list(MODEL_KEYS), sort=False):
        table[key] = part.sort_values("score")[["score", "n", "below", "prev", "next"]].to_numpy(dtype=float)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("struct<score: double, n: bigint, below: bigint, prev: double, next: double>")
    def find(model: pd.Series, version: pd.Series, score: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.full((len(score), 5), np.nan), columns=["score", "n", "below", "prev", "next"])
        for key, at in pd.DataFrame({"m": model, "v": version}).groupby(["m", "v"], sort=False).indices.items():
            grid = shared.value.get(key)
            if grid is None:
                continue
            pos = np.searchsorted(grid[:, 0], score.to_numpy()[at], side="right") - 1
            hit = pos >= 0
            out.iloc[at[hit]] = grid[pos[hit]]
        return out.astype({"n": "Int64", "below": "Int64"})

    return rows.withColumn("step", find("model_name", "model_version", "score"))


def cdf_position(score: Column, step: Column, n: Column) -> Column:
    """Interpolated rank of a score strictly between the reference extremes.

    With r_k the largest reference score under s and r_k+1 the smallest at or above it:
    (k + (s - r_k)/(r_k+1 - r_k)) / (n - 1), k = samples under s minus 1.  A score equal
    to a reference score sits on its lowest tied rank.
    """
    on_step = step["below"] / (n - 1)
    k = step["below"] + step["n"] - 1
    between = (k + (score - step["score"]) / (step["next"] - step["score"])) / (n - 1)
    return F.when(step["score"] == score, on_step).otherwise(between)


def calibrate(scores: DataFrame, reference: DataFrame, cfg: CalibrationConfig, cutoff=None, strict: bool = True) -> DataFrame:
    """Adds status, calibrated_score, severity and sample_count to every score row.

    ``scores`` has source_signal_id, model_name, model_version and score.  Statuses in
    order: invalid_input (no id, or a score that is not a number in [0, 1]), unsupported_model,
    missing_calibration, invalid_input (the id is part of the reference), success.
    Rows without an id do not take part in the join with the reference.
    """
    keys = list(MODEL_KEYS)
    fit = fit_calibration(reference, cfg, cutoff, strict)
    small = fit.select(*keys, "sample_count", "low", "high", "is_degenerate", F.lit(True).alias("_fitted"))
    leaked = reference.where(F.col("sample_id").isNotNull()).select(*keys, F.col("sample_id").alias("source_signal_id")).distinct().withColumn("_leak", F.lit(True))
    known = lookup_join(scores, materialise(small), keys, ["source_signal_id"], "left")
    nameless = known.where(F.col("source_signal_id").isNull()).withColumn("_leak", F.lit(None).cast("boolean"))
    checked = known.where(F.col("source_signal_id").isNotNull()).join(leaked, [*keys, "source_signal_id"], "left").unionByName(nameless)
    usable = F.coalesce(is_finite(F.col("score")) & F.col("score").between(0.0, 1.0), F.lit(False))
    status = (
        F.when(F.col("source_signal_id").isNull() | ~usable, "invalid_input")
        .when(~_supported(cfg), "unsupported_model")
        .when(F.col("_fitted").isNull(), "missing_calibration")
        .when(F.col("_leak"), "invalid_input")
        .otherwise("success")
    )
    graded = checked.withColumn("status", status).drop("_leak", "_fitted")
    if cfg.method == "identity":
        placed, position = graded.withColumn("step", F.lit(None)), clamp(F.col("score"))
    else:
        steps = materialise(reference_steps(reference.join(fit.select(*keys), keys, "left_semi")))
        inline = steps.count() <= cfg.max_inline_scores
        placed = (_floor_step_inline if inline else _floor_step_sliced)(graded, steps)
        position = (
            F.when(F.col("score") <= F.col("low"), F.lit(0.0))
            .when(F.col("score") >= F.col("high"), F.lit(1.0))
            .otherwise(clamp(cdf_position(F.col("score"), F.col("step"), F.col("sample_count"))))
        )
    if cfg.degenerate == "error":
        constant = F.raise_error(F.lit("degenerate calibration distribution")).cast("double")
    else:
        constant = F.when(F.col("score") <= F.col("low"), F.lit(0.0)).otherwise(F.lit(1.0))
    value = F.when(F.col("is_degenerate"), constant).otherwise(position)
    return (
        placed.withColumn("calibrated_score", F.when(F.col("status") == "success", value))
        .withColumn("severity", calibrated_severity(F.col("calibrated_score"), cfg))
        .drop("step", "low", "high", "is_degenerate")
    )


def calibrated_severity(score: Column, cfg: CalibrationConfig = CalibrationConfig()) -> Column:
    """debug under .20, info under .50, warning under .75, error under .90, else critical."""
    return severity_from_score(score, cfg.bands, "debug")


def raw_comparison(outputs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Raw and normalised scores of several detectors in one table, successful rows only."""
    shaped = []
    for df in outputs:
        kind = F.create_map(*[F.lit(x) for m, (t, _) in RAW_SCORES.items() for x in (m, t)])
        direction = F.create_map(*[F.lit(x) for m, (_, d) in RAW_SCORES.items() for x in (m, d)])
        residual = F.col("residual") if "residual" in df.columns else F.lit(None).cast("double")
        shaped.append(
            df.where("status = 'success'").select(
                *keys,
                "window_index",
                F.col("observation_timestamp").alias("event_time"),
                "model_name",
                "model_version",
                kind[F.col("model_name")].alias("raw_score_type"),
                direction[F.col("model_name")].alias("raw_score_direction"),
                "raw_score",
                residual.alias("signed_residual"),
                F.col("anomaly_score").alias("baseline_normalized_score"),
            )
        )
    result = shaped[0]
    for df in shaped[1:]:
        result = result.unionByName(df)
    return result


def calibrated_signals(signals: DataFrame, calibrated: DataFrame, cfg: CalibrationConfig) -> DataFrame:
    """New signal rows carrying the calibrated score; the source rows stay as they are.

    Each evidence entry gets calibrated_score, calibration_method and
    source_baseline_score in its details; a signal without evidence gets one entry.
    """
    extra = calibrated.where("status = 'success'").select(
        F.col("source_signal_id").alias("signal_id"),
        "calibrated_score",
        F.col("severity").alias("_severity"),
        F.col("sample_count").alias("_samples"),
    )
    joined = signals.join(extra, "signal_id")
    added = F.create_map(
        F.lit("calibrated_score"), F.col("calibrated_score").cast("string"),
        F.lit("calibration_method"), F.lit(cfg.method),
        F.lit("source_baseline_score"), F.col("anomaly_score").cast("string"),
    )
    names = [f.name for f in signals.schema["evidence"].dataType.elementType.fields]

    def update(ev: Column) -> Column:
        kept = F.map_filter(ev["details"], lambda k, _: ~k.isin("calibrated_score", "calibration_method", "source_baseline_score"))
        details = F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), added)
        return F.struct(*[(details if n == "details" else ev[n]).alias(n) for n in names])

    types = {f.name: f.dataType for f in signals.schema["evidence"].dataType.elementType.fields}
    fallback_values = {
        "evidence_type": F.concat(F.col("model_name"), F.lit("_calibrated_score")),
        "metric_or_feature": F.col("metric_or_feature"),
        "observed_value": F.col("anomaly_score"),
        "expected_value": F.lit(0.0),
        "deviation": F.col("anomaly_score"),
        "details": added,
        "timestamp": F.col("event_time"),
    }
    fallback = F.array(F.struct(*[fallback_values[n].cast(types[n]).alias(n) for n in names]))
    evidence = F.when(F.size("evidence") > 0, F.transform("evidence", update)).otherwise(fallback)
    return (
        joined.withColumn("evidence", evidence)
        .withColumn("anomaly_score", F.col("calibrated_score"))
        .withColumn("severity", F.col("_severity"))
        .withColumn(
            "tags",
            F.create_map(F.lit("calibration_status"), F.lit("calibrated"), F.lit("source_signal_id"), F.col("signal_id").cast("string")),
        )
        .drop("calibrated_score", "_severity", "_samples")
    )
