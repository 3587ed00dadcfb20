"""Queries over score calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import calibration as C, detectors as D, features as W
from opsweave.plans import detectors as PD
from opsweave.plans.inputs import load
from opsweave.plans.registry import query, round6

CUTOFF = "2024-01-16 00:00:00"
ANY_MODEL = C.CalibrationConfig(supported_models=None)

# Model = event type, version = severity band.  The critical band is capped at 1, so its
# reference is constant (the degenerate case).  The reference is everything before the cutoff.
SCORED = """scored AS (SELECT event_id AS source_signal_id, service AS model_name, severity AS model_version,
  least(value / CAST(200 AS DOUBLE), CAST(1 AS DOUBLE)) AS score, event_time FROM telemetry),
ref AS (SELECT * FROM scored WHERE event_time <= TIMESTAMP '2024-01-16 00:00:00')"""


def _scored(spark, folder):
    t = load(spark, folder, "telemetry")
    return t.select(
        F.col("event_id").alias("source_signal_id"),
        F.col("service").alias("model_name"),
        F.col("severity").alias("model_version"),
        F.least(F.col("value") / F.lit(200.0), F.lit(1.0)).alias("score"),
        "event_time",
    )


def _reference(scored):
    return scored.where(F.col("event_time") <= F.lit(CUTOFF).cast("timestamp")).select(
        F.col("source_signal_id").alias("sample_id"),
        "model_name",
        "model_version",
        "score",
        "event_time",
        F.lit("calibration").alias("partition_role"),
    )


@query(
    "C1_reference_report",
    f"""WITH {SCORED},
roles AS (SELECT *, CASE WHEN event_time > TIMESTAMP '2024-01-16 00:00:00' AND model_name = 'error' THEN 'evaluation' ELSE 'calibration' END AS role FROM scored
  WHERE event_time <= TIMESTAMP '2024-01-16 00:00:00' OR model_name IN ('error', 'view')),
g AS (SELECT model_name, model_version, count(*) AS sample_count, min(score) AS low, max(score) AS high,
  count(*) FILTER (WHERE role <> 'calibration') AS foreign_samples,
  count(*) FILTER (WHERE event_time > TIMESTAMP '2024-01-16 00:00:00') AS late_samples FROM roles GROUP BY ALL)
SELECT model_name, model_version, sample_count, r6(low) AS low, r6(high) AS high, low = high AS is_degenerate,
  CASE WHEN model_name = 'signup' THEN 'unsupported_model' WHEN sample_count < 30 THEN 'insufficient_reference_data'
    WHEN foreign_samples > 0 THEN 'leakage_partition_role' WHEN late_samples > 0 THEN 'leakage_after_cutoff' ELSE 'fitted' END AS verdict FROM g""",
    ("telemetry",),
)
def reference_report(spark, folder):
    scored = _scored(spark, folder)
    late = F.col("event_time") > F.lit(CUTOFF).cast("timestamp")
    roles = scored.where(~late | F.col("model_name").isin("error", "view")).select(
        F.col("source_signal_id").alias("sample_id"),
        "model_name",
        "model_version",
        "score",
        "event_time",
        F.when(late & (F.col("model_name") == "error"), "evaluation").otherwise("calibration").alias("partition_role"),
    )
    cfg = C.CalibrationConfig(min_samples=30, supported_models=("click", "error", "purchase", "view"))
    return C.reference_report(roles, cfg, CUTOFF).select(
        "model_name", "model_version", "sample_count", round6("low").alias("low"), round6("high").alias("high"), "is_degenerate", "verdict"
    )


_CALIBRATED = f"""WITH {SCORED},
fit AS (SELECT model_name, model_version, count(*) AS n, min(score) AS lo, max(score) AS hi FROM ref GROUP BY ALL HAVING count(*) >= 10),
pos AS (SELECT s.source_signal_id, count(*) FILTER (WHERE r.score < s.score) AS below,
  max(r.score) FILTER (WHERE r.score < s.score) AS rk, min(r.score) FILTER (WHERE r.score >= s.score) AS rk1
  FROM scored s JOIN ref r ON r.model_name = s.model_name AND r.model_version = s.model_version GROUP BY s.source_signal_id),
c AS (SELECT s.source_signal_id, s.model_name, s.model_version, s.event_time,
  CASE WHEN f.n IS NULL THEN 'missing_calibration' WHEN s.event_time <= TIMESTAMP '2024-01-16 00:00:00' THEN 'invalid_input' ELSE 'success' END AS status,
  CASE WHEN f.lo = f.hi THEN CASE WHEN s.score <= f.lo THEN 0.0 ELSE 1.0 END
    WHEN s.score <= f.lo THEN 0.0 WHEN s.score >= f.hi THEN 1.0
    ELSE (p.below - 1 + (s.score - p.rk) / (p.rk1 - p.rk)) / (f.n - 1) END AS v, s.score, f.lo, f.hi
  FROM scored s LEFT JOIN fit f USING (model_name, model_version) LEFT JOIN pos p ON p.source_signal_id = s.source_signal_id)"""


def _calibrated(spark, folder, cfg=ANY_MODEL):
    scored = _scored(spark, folder)
    return C.calibrate(scored, _reference(scored), cfg, CUTOFF, strict=False)


_OUT = f"""{_CALIBRATED}
SELECT source_signal_id, status, r6(CASE WHEN status = 'success' THEN CAST(v AS DOUBLE) END) AS calibrated_score FROM c"""


def _out(df):
    return df.select("source_signal_id", "status", round6("calibrated_score").alias("calibrated_score"))


@query("C2_calibrate_inline", _OUT, ("telemetry",))
def calibrate_inline(spark, folder):
    return _out(_calibrated(spark, folder))


@query(
    "C2_unusable_scores",
    """SELECT event_id AS source_signal_id, CASE WHEN event_id % 5 < 4 THEN 'invalid_input' WHEN event_time <= TIMESTAMP '2024-01-16 00:00:00' THEN 'invalid_input' ELSE 'success' END AS status,
  event_id % 5 = 4 AND event_time > TIMESTAMP '2024-01-16 00:00:00' AS has_score FROM telemetry""",
    ("telemetry",),
)
def unusable_scores(spark, folder):
    """Null, NaN and out-of-range scores, against one reference for all."""
    scored = _scored(spark, folder).withColumn("model_name", F.lit("one")).withColumn("model_version", F.lit("1"))
    case = F.col("source_signal_id") % 5
    broken = F.when(case == 1, F.lit(float("nan"))).when(case == 2, F.lit(5.0)).when(case == 3, F.lit(-0.1)).when(case == 4, F.col("score"))
    out = C.calibrate(scored.withColumn("score", broken), _reference(scored), ANY_MODEL, CUTOFF, strict=False)
    return out.select("source_signal_id", "status", (F.col("calibrated_score").isNotNull() & F.col("severity").isNotNull()).alias("has_score"))


@query("C2_calibrate_sliced", _OUT, ("telemetry",))
def calibrate_sliced(spark, folder):
    return _out(_calibrated(spark, folder, C.CalibrationConfig(supported_models=None, max_inline_scores=0)))


@query(
    "C3_degenerate_reference",
    f"""{_CALIBRATED}
SELECT model_name, model_version, count(*) AS rows_scored, count(*) FILTER (WHERE v = 0) AS zeros, count(*) FILTER (WHERE v = 1) AS ones
FROM c WHERE status = 'success' AND lo = hi GROUP BY ALL""",
    ("telemetry",),
)
def degenerate(spark, folder):
    scored = _scored(spark, folder)
    flat = C.reference_report(_reference(scored), ANY_MODEL).where("is_degenerate").select(*C.MODEL_KEYS)
    out = C.calibrate(scored, _reference(scored), ANY_MODEL, CUTOFF, strict=False).where("status = 'success'")
    return out.join(flat, list(C.MODEL_KEYS), "left_semi").groupBy(*C.MODEL_KEYS).agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.count_if(F.col("calibrated_score") == 0).alias("zeros"),
        F.count_if(F.col("calibrated_score") == 1).alias("ones"),
    )


@query(
    "C4_identity_method",
    f"""{_CALIBRATED}
SELECT source_signal_id, r6(CASE WHEN status = 'success' THEN CAST(CASE WHEN lo = hi THEN v ELSE least(1.0, greatest(0.0, score)) END AS DOUBLE) END) AS calibrated_score FROM c""",
    ("telemetry",),
)
def identity(spark, folder):
    out = _calibrated(spark, folder, C.CalibrationConfig(method="identity", supported_models=None))
    return out.select("source_signal_id", round6("calibrated_score").alias("calibrated_score"))


@query(
    "C5_leakage_guard",
    """WITH s AS (SELECT event_id, kind, service, event_time FROM telemetry)
SELECT event_id, CASE WHEN kind = 'system' THEN 'invalid_input' WHEN service = 'signup' THEN 'unsupported_model'
  WHEN service = 'error' THEN 'missing_calibration' WHEN event_time <= TIMESTAMP '2024-01-16 00:00:00' THEN 'invalid_input' ELSE 'success' END AS status FROM s""",
    ("telemetry",),
)
def leakage(spark, folder):
    t = load(spark, folder, "telemetry")
    base = t.select(
        "event_id", "kind", F.col("service").alias("model_name"), F.lit("1").alias("model_version"),
        F.least(F.col("value") / F.lit(200.0), F.lit(1.0)).alias("score"), "event_time",
    )
    scores = base.withColumn("source_signal_id", F.when(F.col("kind") != "system", F.col("event_id")))
    reference = _reference(base.withColumnRenamed("event_id", "source_signal_id")).where("model_name <> 'error'")
    cfg = C.CalibrationConfig(supported_models=("click", "error", "purchase", "view"))
    return C.calibrate(scores, reference, cfg, CUTOFF, strict=False).select("event_id", "status")


@query(
    "C6_calibrated_severity",
    f"""{_CALIBRATED}
SELECT source_signal_id, CASE WHEN status <> 'success' THEN NULL WHEN v < 0.2 THEN 'debug' WHEN v < 0.5 THEN 'info'
  WHEN v < 0.75 THEN 'warning' WHEN v < 0.9 THEN 'error' ELSE 'critical' END AS severity FROM c""",
    ("telemetry",),
)
def severity(spark, folder):
    return _calibrated(spark, folder).select("source_signal_id", "severity")


@query(
    "C7_raw_comparison",
    f"""WITH {PD.forecast_sql('linear')},
flat AS (SELECT * FROM scored WHERE status = 'success')
SELECT environment, service, window_index, 'forecast' AS model_name, 'forecast_absolute_deviation' AS raw_score_type,
  'higher_is_more_anomalous' AS raw_score_direction, r6(abs(y - expected)) AS raw_score, r6(y - expected) AS signed_residual,
  r6(anomaly_score) AS baseline_normalized_score FROM flat""",
    ("observations",),
)
def raw_comparison(spark, folder):
    windows = W.extract(load(spark, folder, "observations"), PD.BASE, PD.KEYS)
    out = C.raw_comparison([D.forecast_residual(windows, D.ForecastConfig(PD.TARGET), PD.KEYS)], list(PD.KEYS))
    return out.select(
        *PD.KEYS, "window_index", "model_name", "raw_score_type", "raw_score_direction",
        *[round6(c).alias(c) for c in ("raw_score", "signed_residual", "baseline_normalized_score")],
    )


@query("C8_calibrated_signals")
def calibrated_signals(spark, folder):
    windows = W.extract(load(spark, folder, "observations"), PD.BASE, PD.KEYS)
    signals = W.materialise(
        D.to_signals(D.forecast_residual(windows, D.ForecastConfig(PD.TARGET), PD.KEYS), PD.TARGET, PD.KEYS, "forecast_residual")
    )
    scores = signals.select(
        F.col("signal_id").alias("source_signal_id"), "model_name", "model_version", F.col("anomaly_score").alias("score"), "event_time"
    )
    out = C.calibrate(scores, _reference(scores), C.CalibrationConfig(), CUTOFF, strict=False)
    rebuilt = C.calibrated_signals(signals, out, C.CalibrationConfig())
    details = F.col("evidence")[0]["details"]
    return rebuilt.select(
        "signal_id", round6("anomaly_score").alias("anomaly_score"), "severity",
        round6(details["calibrated_score"].cast("double")).alias("evidence_score"), details["calibration_method"].alias("method"),
    )
