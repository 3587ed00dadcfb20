"""End-to-end evaluation: features, detectors, calibration, decisions, metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from opsweave.operators import calibration as C, causal, detectors as D, evaluation as E, features as W
from opsweave.session import materialise


@dataclass(frozen=True)
class EvaluationConfig:
    """One scenario per value of ``scenario_key``; every series key value is scored on its own."""

    features: W.FeatureConfig
    series_keys: tuple[str, ...]
    scenario_key: str
    run_key: str
    models: tuple[str, ...] = ("forecast", "isolation_forest", "reconstruction")
    min_history: int = 5
    refit_every: int = 1
    trees: int = 100
    threshold: float = 0.5
    calibration: C.CalibrationConfig = field(default_factory=C.CalibrationConfig)
    package: str = "evaluation"
    version: str = "1.0.0"


def score_models(windows: DataFrame, cfg: EvaluationConfig) -> DataFrame:
    """Scores of all configured models over the same windows, in one long table."""
    keys, columns = list(cfg.series_keys), cfg.features.columns
    parts = []
    for model in cfg.models:
        if model == "forecast":
            scored = D.forecast_residual(windows, D.ForecastConfig(columns[0], min_history=cfg.min_history), keys)
        else:
            scored = causal.score_causal(
                windows, columns, keys, model, refit_every=cfg.refit_every, min_history=cfg.min_history, trees=cfg.trees
            )
        parts.append(
            scored.select(
                *keys, "window_index", "window_start", "window_end", "observation_timestamp", "model_name", "model_version",
                F.col("status").alias("detector_status"), F.col("raw_score").cast("double").alias("raw_score"), "anomaly_score",
            )
        )
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def _signal_id(df: DataFrame, cfg: EvaluationConfig) -> DataFrame:
    name = E.joined("model_name", "model_version", *cfg.series_keys, "window_index", sep=":")
    return df.withColumn("source_signal_id", E.uuid5(E.EVALUATION_NAMESPACE, name))


def evaluate(calibration_obs: DataFrame, evaluation_obs: DataFrame, truth: DataFrame, cfg: EvaluationConfig, cutoff=None) -> dict[str, DataFrame]:
    """outcomes, scenarios, models, latency and distributions for two disjoint observation sets.

    ``truth`` has one interval per run (run key, truth_start, truth_end).  Every window of
    the evaluation set is one unit, scored by every model.
    """
    keys = list(cfg.series_keys)
    reference_windows = materialise(W.extract(calibration_obs, cfg.features, keys))
    reference = _signal_id(score_models(reference_windows, cfg), cfg).where("detector_status = 'success'").select(
        F.col("source_signal_id").alias("sample_id"), "model_name", "model_version", F.col("anomaly_score").alias("score"),
        F.col("observation_timestamp").alias("event_time"), F.lit("calibration").alias("partition_role"),
    )
    windows = materialise(W.extract(evaluation_obs, cfg.features, keys))
    scored = _signal_id(score_models(windows, cfg), cfg)
    ready = scored.withColumn("score", F.col("anomaly_score"))
    calibrated = C.calibrate(ready, materialise(reference), cfg.calibration, cutoff, strict=False).withColumnRenamed("status", "calibration_status")
    labelled = E.label_windows(calibrated, truth, [cfg.run_key])
    status = E.outcome_status(F.col("detector_status"), F.col("anomaly_score"), F.col("calibration_status"))
    unit = E.joined(*keys, "window_index", sep=":")
    outcomes = labelled.withColumn("status", status).withColumn(
        "calibrated_score", F.when(F.col("status") == "success", F.col("calibrated_score"))
    ).withColumn("severity", F.when(F.col("status") == "success", F.col("severity")))
    outcomes = E.decide(outcomes, cfg.threshold).select(
        unit.alias("unit_id"), F.col("window_index").alias("unit_index"), F.col(cfg.scenario_key).cast("string").alias("scenario_id"),
        F.col(cfg.run_key).cast("string").alias("run_id"), "model_name", "model_version", F.col("observation_timestamp").alias("event_time"),
        "truth_start", "ground_truth_positive", "status", "raw_score", F.col("anomaly_score").alias("baseline_normalized_score"),
        "calibrated_score", "severity", "predicted_positive", "is_true_positive", "is_false_positive", "is_true_negative", "is_false_negative",
        "source_signal_id",
    )
    outcomes = materialise(outcomes.withColumn("outcome_id", E.outcome_id(cfg.package, cfg.version)))
    scenarios = E.by_scenario(outcomes)
    return {
        "outcomes": outcomes,
        "scenarios": scenarios,
        "models": E.by_model(scenarios),
        "latency": E.latency_summary(scenarios),
        "distributions": E.score_distributions(outcomes, ["model_name"]),
    }
