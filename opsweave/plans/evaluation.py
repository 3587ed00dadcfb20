"""Queries over evaluation against ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.functions.identity import EVALUATION_NAMESPACE
from opsweave.operators import evaluation as E, features as W
from opsweave.plans.features import H, windows_sql
from opsweave.plans.inputs import load
from opsweave.plans.registry import query, round6
from opsweave.session import shared_folder
from opsweave.sources.stores import artifact_manifest, write_evaluation

MODELS = ("a", "b")

# Outcomes from the labelled documents: one unit per document, two score models.
OUTCOMES = """o AS (SELECT CAST(unit_id AS VARCHAR) AS unit_id, unit_id AS unit_index, scenario_id, 'run-1' AS run_id, model_name,
  truth AS ground_truth_positive, status, CASE WHEN status = 'success' THEN score END AS calibrated_score,
  1704067200000000 + unit_id * 1000000 AS event_us FROM labelled),
d AS (SELECT *, coalesce(status = 'success' AND calibrated_score >= 0.5, false) AS predicted FROM o)"""


def _outcomes(spark, folder):
    v = load(spark, folder, "labelled")
    o = v.select(
        F.col("unit_id").cast("string").alias("unit_id"),
        F.col("unit_id").alias("unit_index"),
        "scenario_id",
        F.lit("run-1").alias("run_id"),
        "model_name",
        F.col("truth").alias("ground_truth_positive"),
        "status",
        F.when(F.col("status") == "success", F.col("score")).alias("calibrated_score"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("unit_id") * 1000000).alias("event_time"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("truth_start"),
    )
    return E.decide(o).withColumn("outcome_id", E.outcome_id("pkg", "1.0.0"))


RUNS = """runs AS (SELECT run_id, min(epoch_us(event_time)) AS start_us, max(epoch_us(event_time)) AS end_us FROM telemetry GROUP BY run_id),
truth AS (SELECT run_id, CASE WHEN (end_us - start_us) / 1000000.0 > 345600 THEN start_us + 172800000000 END AS truth_start_us,
  CASE WHEN (end_us - start_us) / 1000000.0 > 345600 THEN start_us + 345600000000 END AS truth_end_us FROM runs)"""


def _truth(spark, folder):
    runs = load(spark, folder, "telemetry").groupBy("run_id").agg(F.min("event_time").alias("run_start"), F.max("event_time").alias("_end"))
    return E.truth_intervals(
        runs.select(
            "run_id",
            "run_start",
            F.lit(2 * 86400.0).alias("activation_seconds"),
            F.lit(4 * 86400.0).alias("recovery_seconds"),
            ((F.unix_micros("_end") - F.unix_micros("run_start")) / F.lit(1_000_000.0)).alias("total_seconds"),
        )
    )


@query("E1_truth_intervals", f"WITH {RUNS} SELECT run_id, truth_start_us, truth_end_us FROM truth", ("telemetry",))
def truth(spark, folder):
    return _truth(spark, folder).select(
        "run_id", F.unix_micros("truth_start").alias("truth_start_us"), F.unix_micros("truth_end").alias("truth_end_us")
    )


LABEL_CFG = W.FeatureConfig(("latency_ms:mean",), 6 * H, 6 * H, imputation="none")
LABEL_KEYS = ("service", "run_id")


@query(
    "E2_label_windows",
    f"""WITH {windows_sql(LABEL_CFG, LABEL_KEYS)}, {RUNS}
SELECT a.service, a.run_id, a.window_index,
  coalesce(t.truth_start_us <= a.origin_us + a.window_index * {LABEL_CFG.step_us}
   AND a.origin_us + a.window_index * {LABEL_CFG.step_us} < t.truth_end_us, false) AS ground_truth_positive
FROM agg a LEFT JOIN truth t ON t.run_id = a.run_id""",
    ("observations",),
)
def labels(spark, folder):
    windows = W.extract(load(spark, folder, "observations"), LABEL_CFG, LABEL_KEYS)
    return E.label_windows(windows, _truth(spark, folder), ["run_id"]).select(*LABEL_KEYS, "window_index", "ground_truth_positive")


@query(
    "E3_decisions",
    f"WITH {OUTCOMES} SELECT unit_id, model_name, predicted AS predicted_positive FROM d",
    ("labelled",),
)
def decisions(spark, folder):
    return _outcomes(spark, folder).select("unit_id", "model_name", "predicted_positive")


_COUNTS = """count(*) FILTER (WHERE ground_truth_positive AND predicted) AS tp,
  count(*) FILTER (WHERE NOT ground_truth_positive AND predicted) AS fp,
  count(*) FILTER (WHERE NOT ground_truth_positive AND NOT predicted) AS tn,
  count(*) FILTER (WHERE ground_truth_positive AND NOT predicted) AS fn, count(*) AS total_units,
  count(*) FILTER (WHERE status = 'success') AS success_units,
  count(*) FILTER (WHERE status IN ('insufficient_data', 'not_applicable')) AS insufficient_units,
  count(*) FILTER (WHERE status IN ('fit_failure', 'model_failure', 'non_convergence', 'invalid_input', 'missing_calibration')) AS failure_units"""
SCENARIO = f"""{OUTCOMES},
c AS (SELECT scenario_id, model_name, {_COUNTS}, min(event_us) FILTER (WHERE ground_truth_positive AND predicted) AS first_us FROM d GROUP BY ALL),
p AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate,
  CASE WHEN first_us IS NOT NULL THEN 'detected' WHEN success_units = 0 THEN 'failed' ELSE 'not_detected' END AS detection_status,
  round((first_us - 1704067200000000) / 1000000.0, 6) AS latency_seconds FROM c),
s AS (SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM p)"""


@query(
    "E4_confusion_counts",
    f"WITH {OUTCOMES} SELECT scenario_id, model_name, {_COUNTS} FROM d GROUP BY ALL",
    ("labelled",),
)
def confusion(spark, folder):
    return E.by_scenario(_outcomes(spark, folder)).select("scenario_id", "model_name", *E.COUNTS)


@query(
    "E5_outcome_status",
    """SELECT event_id, CASE kind WHEN 'system' THEN 'insufficient_data' WHEN 'log' THEN
  CASE service WHEN 'click' THEN 'insufficient_data' WHEN 'view' THEN 'non_convergence' WHEN 'error' THEN 'fit_failure'
    WHEN 'signup' THEN 'invalid_input' ELSE 'model_failure' END
  ELSE CASE WHEN value > 100 THEN 'model_failure' WHEN service = 'click' THEN 'missing_calibration' WHEN service = 'view' THEN 'invalid_input' ELSE 'success' END END AS status
FROM telemetry""",
    ("telemetry",),
)
def statuses(spark, folder):
    t = load(spark, folder, "telemetry")
    words = F.create_map(*[F.lit(x) for x in (
        "click", "insufficient_history", "view", "non_convergence", "error", "fit_failure", "signup", "invalid_input", "purchase", "degenerate_series")])
    detector = F.when(F.col("kind") == "log", words[F.col("service")]).when(F.col("kind") == "metric", "success")
    calibration = F.when(F.col("service") == "click", "missing_calibration").when(F.col("service") == "view", "unsupported_model").otherwise("success")
    return t.select("event_id", E.outcome_status(detector, F.col("value") / F.lit(100.0), calibration).alias("status"))


@query(
    "E6_precision_recall_fpr",
    f"""WITH {SCENARIO} SELECT scenario_id, model_name, precision, recall, false_positive_rate,
  CASE WHEN tp + fp = 0 THEN 'zero_denominator: TP + FP == 0' END AS precision_reason,
  CAST(tp AS DOUBLE) AS recall_numerator, CAST(tp + fn AS DOUBLE) AS recall_denominator FROM s""",
    ("labelled",),
)
def ratios(spark, folder):
    return E.by_scenario(_outcomes(spark, folder)).select(
        "scenario_id", "model_name", "precision", "recall", "false_positive_rate",
        F.col("precision_detail.reason").alias("precision_reason"),
        F.col("recall_detail.numerator").alias("recall_numerator"),
        F.col("recall_detail.denominator").alias("recall_denominator"),
    )


@query(
    "E7_f1",
    f"""WITH {SCENARIO} SELECT scenario_id, model_name, f1,
  CASE WHEN f1 IS NULL THEN 'undefined' ELSE 'defined' END AS f1_status FROM s""",
    ("labelled",),
)
def f1(spark, folder):
    return E.by_scenario(_outcomes(spark, folder)).select("scenario_id", "model_name", "f1", F.col("f1_detail.status").alias("f1_status"))


_DIST = """SELECT model_name, distribution_name, count(*) AS count, r6(min(s)) AS min, r6(quantile_cont(s, 0.25)) AS p25,
  r6(quantile_cont(s, 0.5)) AS median, r6(avg(s)) AS mean, r6(quantile_cont(s, 0.75)) AS p75, r6(quantile_cont(s, 0.95)) AS p95, r6(max(s)) AS max
FROM long GROUP BY model_name, distribution_name"""


@query(
    "E8_score_distributions",
    f"""WITH {OUTCOMES},
long AS (SELECT model_name, CASE WHEN ground_truth_positive THEN 'truth_positive' ELSE 'truth_negative' END AS distribution_name, calibrated_score AS s
    FROM d WHERE calibrated_score IS NOT NULL
  UNION ALL SELECT model_name, CASE WHEN predicted THEN 'predicted_positive' ELSE 'predicted_negative' END, calibrated_score FROM d WHERE calibrated_score IS NOT NULL)
{_DIST}""",
    ("labelled",),
)
def distributions(spark, folder):
    out = E.score_distributions(_outcomes(spark, folder), ["model_name"])
    return out.select("model_name", "distribution_name", "count", *[round6(c).alias(c) for c in ("min", "p25", "median", "mean", "p75", "p95", "max")])


@query(
    "E9_detection_latency",
    f"WITH {SCENARIO} SELECT scenario_id, model_name, detection_status, latency_seconds, first_us FROM s",
    ("labelled",),
)
def latency(spark, folder):
    return E.by_scenario(_outcomes(spark, folder)).select(
        "scenario_id", "model_name", "detection_status", "latency_seconds", F.unix_micros("first_true_positive").alias("first_us")
    )


@query(
    "E10_by_scenario",
    f"""WITH {SCENARIO} SELECT scenario_id, model_name, tp, fp, tn, fn, total_units, precision, recall, f1, false_positive_rate,
  detection_status, latency_seconds FROM s""",
    ("labelled",),
)
def by_scenario(spark, folder):
    return E.by_scenario(_outcomes(spark, folder)).select(
        "scenario_id", "model_name", "tp", "fp", "tn", "fn", "total_units", "precision", "recall", "f1", "false_positive_rate",
        "detection_status", "latency_seconds",
    )


@query(
    "E11_by_model",
    f"""WITH {SCENARIO},
m AS (SELECT model_name, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn,
  CAST(sum(total_units) AS BIGINT) AS total_units, round(round(avg(precision), 6) + 1e-9, 4) AS macro_precision, round(round(avg(recall), 6) + 1e-9, 4) AS macro_recall, round(round(avg(f1), 6) + 1e-9, 4) AS macro_f1,
  round(round(avg(false_positive_rate), 6) + 1e-9, 4) AS macro_false_positive_rate, count(precision) AS macro_contributing_scenarios FROM s GROUP BY model_name),
r AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate FROM m)
SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM r""",
    ("labelled",),
)
def by_model(spark, folder):
    out = E.by_model(E.by_scenario(_outcomes(spark, folder)))
    return out.select(
        "model_name", "tp", "fp", "tn", "fn", "total_units", "macro_contributing_scenarios",
        "precision", "recall", "f1", "false_positive_rate",
        # The operator rounds to six places; one shared tie there must not decide the check.
        *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "macro_false_positive_rate")],
    )


@query(
    "E12_latency_summary",
    f"""WITH {SCENARIO}
SELECT model_name, count(*) AS total_scenarios, count(latency_seconds) AS detected_scenarios, count(*) - count(latency_seconds) AS missing_scenarios,
  r6(min(latency_seconds)) AS min_seconds, r6(avg(latency_seconds)) AS mean_seconds, r6(quantile_cont(latency_seconds, 0.5)) AS median_seconds,
  r6(quantile_cont(latency_seconds, 0.95)) AS p95_seconds, r6(max(latency_seconds)) AS max_seconds FROM s GROUP BY model_name""",
    ("labelled",),
)
def latency_summary(spark, folder):
    out = E.latency_summary(E.by_scenario(_outcomes(spark, folder)))
    secs = ("min_seconds", "mean_seconds", "median_seconds", "p95_seconds", "max_seconds")
    return out.select("model_name", "total_scenarios", "detected_scenarios", "missing_scenarios", *[round6(c).alias(c) for c in secs])


@query(
    "E13_coverage",
    f"""WITH {SCENARIO},
q AS (SELECT r.scenario_id, m.model_name, s.* EXCLUDE (scenario_id, model_name) FROM
  (SELECT DISTINCT source AS scenario_id FROM documents UNION ALL SELECT 'never-run') r
  CROSS JOIN (SELECT 'a' AS model_name UNION ALL SELECT 'b') m LEFT JOIN s ON s.scenario_id = r.scenario_id AND s.model_name = m.model_name)
SELECT model_name, CAST(count(*) AS INTEGER) AS requested_count, CAST(count(total_units) AS INTEGER) AS executed_count,
  CAST(count(*) FILTER (WHERE success_units > 0) AS INTEGER) AS scored_count,
  CAST(count(*) FILTER (WHERE detection_status = 'detected') AS INTEGER) AS detected_count,
  CAST(count(*) FILTER (WHERE insufficient_units > 0) AS INTEGER) AS insufficient_count,
  CAST(count(*) FILTER (WHERE failure_units > 0) AS INTEGER) AS failed_count,
  coalesce(string_agg(scenario_id, ',' ORDER BY scenario_id) FILTER (WHERE insufficient_units > 0), '') AS insufficient_ids FROM q GROUP BY model_name""",
    ("labelled",),
)
def coverage(spark, folder):
    wanted = load(spark, folder, "documents").select(F.col("source").alias("scenario_id")).distinct()
    wanted = wanted.unionByName(spark.range(1).select(F.lit("never-run").alias("scenario_id")))
    wanted = wanted.withColumn("model_name", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    out = E.coverage(wanted, E.by_scenario(_outcomes(spark, folder)))
    return out.select(
        "model_name", "requested_count", "executed_count", "scored_count", "detected_count", "insufficient_count", "failed_count",
        F.array_join("insufficient_ids", ",").alias("insufficient_ids"),
    )


# Slot problems: every unit's model-b row is recorded twice where the score is low, and
# missing where the status is not success.
_SLOTS = f"""{OUTCOMES},
x AS (SELECT * FROM d WHERE NOT (model_name = 'b' AND status <> 'success')
  UNION ALL SELECT * FROM d WHERE model_name = 'b' AND calibrated_score < 0.1)"""


def _slot_rows(spark, folder):
    d = _outcomes(spark, folder)
    kept = d.where("NOT (model_name = 'b' AND status <> 'success')")
    return kept.unionByName(d.where("model_name = 'b' AND calibrated_score < 0.1"))


@query(
    "E14_slot_accounting",
    f"""WITH {_SLOTS}
SELECT count(DISTINCT unit_id) AS unique_units, count(DISTINCT unit_id) * 2 AS expected_slots, count(*) AS recorded_outcomes,
  count(*) - count(DISTINCT (unit_id, model_name)) AS duplicate_slots,
  count(DISTINCT unit_id) * 2 - count(DISTINCT (unit_id, model_name)) AS missing_slots FROM x""",
    ("labelled",),
)
def slots(spark, folder):
    return E.slot_accounting(_slot_rows(spark, folder), MODELS)


@query(
    "E14_missing_slots",
    f"""WITH {_SLOTS},
w AS (SELECT DISTINCT scenario_id, run_id, unit_id, m.model_name FROM x CROSS JOIN (SELECT 'a' AS model_name UNION ALL SELECT 'b') m)
SELECT scenario_id, unit_id, model_name FROM w WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.unit_id = w.unit_id AND x.model_name = w.model_name)""",
    ("labelled",),
)
def missing(spark, folder):
    return E.missing_slots(_slot_rows(spark, folder), MODELS).select("scenario_id", "unit_id", "model_name")


@query(
    "E15_validate_outcomes",
    f"""WITH {_SLOTS},
ids AS (SELECT unit_id, model_name, scenario_id, unit_index, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1)
SELECT 'duplicate_slot' AS problem, concat_ws(':', scenario_id, 'run-1', unit_id, CAST(unit_index AS VARCHAR), model_name) AS subject, n AS occurrences FROM ids
UNION ALL SELECT 'unknown_model', 'b', count(*) FROM x WHERE model_name = 'b'
UNION ALL SELECT 'unknown_scenario', scenario_id, count(*) FROM x WHERE scenario_id NOT IN (SELECT min(source) FROM documents) GROUP BY scenario_id""",
    ("labelled",),
)
def validate(spark, folder):
    known = load(spark, folder, "documents").agg(F.min("source").alias("scenario_id"))
    out = E.validate_outcomes(_slot_rows(spark, folder), known, ["a"])
    # Ids are name-based on the slot, so a duplicate id repeats a duplicate slot.
    return out.where("problem <> 'duplicate_outcome_id'")


@query(
    "E16_deterministic_ids",
    f"""WITH {OUTCOMES},
h AS (SELECT unit_id, model_name, sha1(unhex('{EVALUATION_NAMESPACE.hex}') || encode(concat_ws(':', 'outcome', 'pkg', '1.0.0', model_name, run_id, scenario_id, unit_id))) AS h FROM o)
SELECT unit_id, model_name, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
  translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3), substr(h, 21, 12)) AS outcome_id FROM h""",
    ("labelled",),
)
def ids(spark, folder):
    return _outcomes(spark, folder).select("unit_id", "model_name", "outcome_id")


@query(
    "E17_split_check",
    """WITH cal AS (SELECT seed, event_time FROM telemetry WHERE event_time <= TIMESTAMP '2024-01-16 00:00:00'),
ev AS (SELECT seed + 100 AS seed, event_time FROM telemetry WHERE event_time > TIMESTAMP '2024-01-16 00:01:00')
SELECT (SELECT count(*) FROM (SELECT DISTINCT seed FROM cal) c WHERE seed IN (SELECT seed FROM ev)) AS shared_seeds,
  (SELECT min(epoch_us(event_time)) FROM ev) - (SELECT max(epoch_us(event_time)) FROM cal) AS gap_us, true AS seeds_differ, true AS gap_kept""",
    ("telemetry",),
)
def split(spark, folder):
    t = load(spark, folder, "telemetry").select("seed", "event_time")
    cal = t.where("event_time <= timestamp'2024-01-16 00:00:00'")
    ev = t.where("event_time > timestamp'2024-01-16 00:01:00'").withColumn("seed", F.col("seed") + 100)
    out = E.split_check(cal, ev)
    return out.select("shared_seeds", F.round(F.col("gap_seconds") * 1_000_000).cast("bigint").alias("gap_us"), "seeds_differ", "gap_kept")


@query(
    "E18_compare_runs",
    """WITH s AS (SELECT run_id, min(epoch_us(event_time)) AS start_us FROM telemetry GROUP BY run_id),
n AS (SELECT t.service, t.metric_name, t.severity, r6((epoch_us(t.event_time) - s.start_us) / 1000000.0) AS offset_seconds, t.kind
  FROM telemetry t JOIN s USING (run_id)),
l AS (SELECT service, metric_name, severity, offset_seconds FROM n), r AS (SELECT service, metric_name, severity, offset_seconds FROM n WHERE kind <> 'system')
SELECT 'left' AS side, * FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) a
UNION ALL SELECT 'right', * FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l) b""",
    ("telemetry",),
)
def compare(spark, folder):
    t = load(spark, folder, "telemetry")
    starts = t.groupBy("run_id").agg(F.min("event_time").alias("run_start"))
    cols = ("run_id", "event_id", "event_time", "service", "metric_name", "severity")
    left = E.normalise_run(t.select(*cols), starts).drop("event_id")
    right = E.normalise_run(t.where("kind <> 'system'").select(*cols), starts).drop("event_id")
    return E.compare_runs(left, right).select("side", "service", "metric_name", "severity", round6("offset_seconds").alias("offset_seconds"))


def _evaluate(spark, folder):
    from opsweave.operators.evaluate_models import EvaluationConfig, evaluate

    obs = load(spark, folder, "observations")
    split_at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    cfg = EvaluationConfig(
        W.FeatureConfig(("latency_ms:mean", "requests_total:mean"), 6 * H, 6 * H), ("service", "run_id"), "service", "run_id",
    )
    return evaluate(obs.where(F.col("event_time") < split_at), obs.where(F.col("event_time") >= split_at), _truth(spark, folder), cfg)


@query("E19_evaluate_models")
def evaluate_models(spark, folder):
    out = _evaluate(spark, folder)
    return out["models"].join(out["latency"], "model_name").select(
        "model_name", "total_units", "tp", "fp", "tn", "fn", "success_units", "insufficient_units", "failure_units", "precision", "recall", "f1",
        "false_positive_rate", "detected_scenarios",
    )


def _written(spark, folder):
    outcomes = _outcomes(spark, folder)
    scenarios = E.by_scenario(outcomes)
    path = shared_folder(spark, "evaluation")
    write_evaluation(outcomes, scenarios, E.by_model(scenarios).join(E.latency_summary(scenarios), "model_name"), path)
    return path


@query(
    "S17_written_outcomes",
    f"WITH {OUTCOMES} SELECT scenario_id, model_name, unit_index, predicted AS predicted_positive FROM d",
    ("labelled",),
)
def written_outcomes(spark, folder):
    back = spark.read.schema("scenario_id string, model_name string, unit_index long, predicted_positive boolean").json(f"{_written(spark, folder)}/outcomes")
    return back.select("scenario_id", "model_name", "unit_index", "predicted_positive")


@query(
    "S18_manifest_counts",
    f"""WITH {OUTCOMES} SELECT 'application/x-ndjson' AS media_type, count(*) AS records FROM d
UNION ALL SELECT 'text/csv', count(DISTINCT model_name) + count(DISTINCT (scenario_id, model_name)) FROM d""",
    ("labelled",),
)
def manifest_counts(spark, folder):
    entries = artifact_manifest(spark, _written(spark, folder)).where("record_count IS NOT NULL")
    return entries.groupBy("media_type").agg(F.sum("record_count").cast("long").alias("records"))
