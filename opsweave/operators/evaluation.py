"""Evaluation of calibrated scores against ground-truth intervals."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opsweave.functions.identity import EVALUATION_NAMESPACE, joined, uuid5
from opsweave.functions.numeric import is_finite
from opsweave.functions.skew import lookup_join
from opsweave.operators.quantiles import HOT_ROWS, exact_quantiles
from opsweave.session import materialise

# Outcome statuses counted as insufficient and as failure.
INSUFFICIENT = ("insufficient_data", "not_applicable")
FAILURES = ("fit_failure", "model_failure", "non_convergence", "invalid_input", "missing_calibration")
SLOT = ("scenario_id", "run_id", "unit_id", "unit_index", "model_name")
UNIT = SLOT[:-1]


def truth_intervals(runs: DataFrame) -> DataFrame:
    """Half-open truth interval per run, or the reason why the run has none.

    Input: run_id, run_start TIMESTAMP, activation_seconds, recovery_seconds (nullable),
    total_seconds.  The interval is [start+activation, start+recovery), to the end of
    the run without a recovery.
    """
    a, r, t = F.col("activation_seconds"), F.col("recovery_seconds"), F.col("total_seconds")
    error = (
        F.when(~is_finite(a.cast("double")) | (a < 0), "activation must be finite and not negative")
        .when(~is_finite(t.cast("double")) | (t <= 0), "total duration must be finite and positive")
        .when(a >= t, "activation must come before the end of the run")
        .when(r.isNotNull() & (r <= a), "recovery must come after activation")
        .when(r.isNotNull() & (r > t), "recovery must not exceed the total duration")
    )

    def at(seconds: Column) -> Column:
        return F.timestamp_micros(F.unix_micros("run_start") + F.round(seconds * 1_000_000).cast("bigint"))

    return (
        runs.withColumn("error", error)
        .withColumn("truth_start", F.when(F.col("error").isNull(), at(a)))
        .withColumn("truth_end", F.when(F.col("error").isNull(), at(F.coalesce(r, t))))
    )


def label_windows(windows: DataFrame, truth: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    """Adds ground_truth_positive: truth_start <= window_start < truth_end of the run.

    ``truth`` has one interval per run; a window of a run without one is negative.
    """
    intervals = materialise(truth.where("truth_start IS NOT NULL").select(*run_keys, "truth_start", "truth_end"))
    joined_ = lookup_join(windows, intervals, list(run_keys), ["window_start", "window_index"], "left")
    inside = (F.col("truth_start") <= F.col("window_start")) & (F.col("window_start") < F.col("truth_end"))
    return joined_.withColumn("ground_truth_positive", F.coalesce(inside, F.lit(False)))


def outcome_status(detector_status: Column, score: Column, calibration_status: Column) -> Column:
    """Outcome status of one unit.

    No detector row: insufficient_data.  A non-success status maps by the first word it
    contains: insufficient, non_convergence, fit_failure, invalid, else model_failure.
    A success without a score in [0, 1] is model_failure.  Otherwise calibration decides:
    success, missing_calibration or invalid_input.
    """
    malformed = ~is_finite(score) | (score < 0) | (score > 1)
    return (
        F.when(detector_status.isNull(), "insufficient_data")
        .when(
            detector_status != "success",
            F.when(detector_status.contains("insufficient"), "insufficient_data")
            .when(detector_status.contains("non_convergence"), "non_convergence")
            .when(detector_status.contains("fit_failure"), "fit_failure")
            .when(detector_status.contains("invalid"), "invalid_input")
            .otherwise("model_failure"),
        )
        .when(F.coalesce(malformed, F.lit(True)), "model_failure")
        .when(calibration_status == "success", "success")
        .when(calibration_status == "missing_calibration", "missing_calibration")
        .otherwise("invalid_input")
    )


def decide(outcomes: DataFrame, threshold: float = 0.5, score: str = "calibrated_score") -> DataFrame:
    """Adds predicted_positive and the four confusion flags.

    Only success rows can be positive; everything else counts as a negative decision.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be in [0, 1]")
    predicted = F.coalesce((F.col("status") == "success") & (F.col(score) >= threshold), F.lit(False))
    truth = F.col("ground_truth_positive")
    return (
        outcomes.withColumn("predicted_positive", predicted)
        .withColumn("is_true_positive", truth & F.col("predicted_positive"))
        .withColumn("is_false_positive", ~truth & F.col("predicted_positive"))
        .withColumn("is_true_negative", ~truth & ~F.col("predicted_positive"))
        .withColumn("is_false_negative", truth & ~F.col("predicted_positive"))
    )


def confusion_aggregates() -> list[Column]:
    return [
        F.count_if("is_true_positive").alias("tp"),
        F.count_if("is_false_positive").alias("fp"),
        F.count_if("is_true_negative").alias("tn"),
        F.count_if("is_false_negative").alias("fn"),
        F.count(F.lit(1)).alias("total_units"),
        F.count_if(F.col("status") == "success").alias("success_units"),
        F.count_if(F.col("status").isin(*INSUFFICIENT)).alias("insufficient_units"),
        F.count_if(F.col("status").isin(*FAILURES)).alias("failure_units"),
    ]


COUNTS = ("tp", "fp", "tn", "fn", "total_units", "success_units", "insufficient_units", "failure_units")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio rounded to six places; null (undefined) for a zero denominator."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 6)


def with_metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, false_positive_rate and ``<metric>_detail`` structs.

    A detail holds status, reason, numerator and denominator.  F1 is computed from the
    rounded precision and recall and is undefined when either is, or when both are 0.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def detail(num: Column, den: Column, text: str) -> Column:
        return F.struct(
            F.when(den == 0, "undefined").otherwise("defined").alias("status"),
            F.when(den == 0, F.lit(f"zero_denominator: {text} == 0")).alias("reason"),
            num.cast("double").alias("numerator"),
            den.cast("double").alias("denominator"),
        )

    out = (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("precision_detail", detail(tp, tp + fp, "TP + FP"))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("recall_detail", detail(tp, tp + fn, "TP + FN"))
        .withColumn("false_positive_rate", ratio(fp, fp + tn))
        .withColumn("false_positive_rate_detail", detail(fp, fp + tn, "FP + TN"))
    )
    p, r = F.col("precision"), F.col("recall")
    undefined = p.isNull() | r.isNull()
    f1_reason = F.when(undefined, "undefined_component: precision or recall is undefined").when(
        p + r == 0, "zero_denominator: precision + recall == 0.0"
    )
    return out.withColumn("f1", F.round(F.try_divide(2 * p * r, p + r), 6)).withColumn(
        "f1_detail",
        F.struct(
            F.when(undefined | (p + r == 0), "undefined").otherwise("defined").alias("status"),
            f1_reason.alias("reason"),
            F.when(~undefined, F.round(2 * p * r, 6)).alias("numerator"),
            F.when(~undefined, F.round(p + r, 6)).alias("denominator"),
        ),
    )


def by_scenario(outcomes: DataFrame, truth_start: str = "truth_start") -> DataFrame:
    """Counts, metrics and detection latency per (scenario, model) in one aggregation.

    Latency runs from the truth start to the first true positive's event time (window
    end).  Without one the status is failed (no success at all) or not_detected.
    """
    counts = outcomes.groupBy("scenario_id", "model_name").agg(
        *confusion_aggregates(),
        F.min(F.when(F.col("is_true_positive"), F.col("event_time"))).alias("first_true_positive"),
        F.min(truth_start).alias("truth_start"),
    )
    hit = F.col("first_true_positive")
    status = (
        F.when(hit.isNotNull(), "detected").when(F.col("success_units") == 0, "failed").otherwise("not_detected")
    )
    seconds = (F.unix_micros(hit) - F.unix_micros("truth_start")) / F.lit(1_000_000.0)
    return (
        with_metrics(counts)
        .withColumn("detection_status", status)
        .withColumn("latency_seconds", F.round(seconds, 6))
    )


def by_model(scenarios: DataFrame) -> DataFrame:
    """Micro metrics from pooled counts and macro means of the defined scenario values.

    Built from the small per-scenario table, so the outcomes are read once.
    """
    macro = ("precision", "recall", "f1", "false_positive_rate")
    pooled = scenarios.groupBy("model_name").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        *[F.round(F.avg(m), 6).alias(f"macro_{m}") for m in macro],
        F.count("precision").alias("macro_contributing_scenarios"),
    )
    return with_metrics(pooled)


def latency_summary(scenarios: DataFrame) -> DataFrame:
    """Detected and missing scenarios with min, mean, median, p95 and max latency per model."""
    seen = F.when(F.col("detection_status") == "detected", F.col("latency_seconds"))
    return scenarios.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total_scenarios"),
        F.count(seen).alias("detected_scenarios"),
        (F.count(F.lit(1)) - F.count(seen)).alias("missing_scenarios"),
        F.round(F.min(seen), 6).alias("min_seconds"),
        F.round(F.avg(seen), 6).alias("mean_seconds"),
        F.round(F.percentile(seen, 0.5), 6).alias("median_seconds"),
        F.round(F.percentile(seen, 0.95), 6).alias("p95_seconds"),
        F.round(F.max(seen), 6).alias("max_seconds"),
    )


def score_distributions(outcomes: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """count, min, p25, median, mean, p75, p95, max of calibrated scores for the truth
    positives and negatives and the predicted positives and negatives.
    """
    side = F.array(
        F.when(F.col("ground_truth_positive"), "truth_positive").otherwise("truth_negative"),
        F.when(F.col("predicted_positive"), "predicted_positive").otherwise("predicted_negative"),
    )
    long = outcomes.where("calibrated_score IS NOT NULL").select(
        *keys, F.explode(side).alias("distribution_name"), "calibrated_score"
    )
    group = [*keys, "distribution_name"]
    s = F.col("calibrated_score")
    plain = long.groupBy(*group).agg(
        F.count(s).alias("count"), F.round(F.min(s), 6).alias("min"), F.round(F.max(s), 6).alias("max"), F.avg(s).alias("mean")
    )
    marks = exact_quantiles(long, group, "calibrated_score", [0.25, 0.5, 0.75, 0.95], "_q", hot_rows)
    names = ("p25", "median", "p75", "p95")
    return plain.join(marks, group).select(*group, "count", "min", "max", "mean", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def coverage(requested: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Requested, executed, scored, detected, insufficient and failed scenarios per model.

    Works on scenario-level rows: the sets hold scenario names only.  ``requested`` has
    one row per (scenario_id, model_name).
    """
    both = requested.join(scenarios, ["scenario_id", "model_name"], "left")
    ran = F.col("total_units").isNotNull()

    def names(cond: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(cond, F.col("scenario_id"))))

    sets = {
        "requested": F.lit(True),
        "executed": ran,
        "feature_ready": ran,
        "scored": F.col("success_units") > 0,
        "evaluable": ran,
        "detected": F.col("detection_status") == "detected",
        "insufficient": F.col("insufficient_units") > 0,
        "failed": F.col("failure_units") > 0,
    }
    grouped = both.groupBy("model_name").agg(*[names(c).alias(f"{n}_ids") for n, c in sets.items()])
    return grouped.select("*", *[F.size(f"{n}_ids").alias(f"{n}_count") for n in sets])


def slot_accounting(outcomes: DataFrame, models: Sequence[str]) -> DataFrame:
    """Unique units, expected, recorded, duplicate and missing (unit, model) slots: one row."""
    slots = outcomes.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("n"))
    units = slots.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("slots"), F.sum("n").alias("n"))
    return units.agg(
        F.count(F.lit(1)).alias("unique_units"),
        (F.count(F.lit(1)) * len(models)).alias("expected_slots"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("recorded_outcomes"),
        F.coalesce(F.sum("n") - F.sum("slots"), F.lit(0)).alias("duplicate_slots"),
        (F.count(F.lit(1)) * len(models) - F.coalesce(F.sum("slots"), F.lit(0))).alias("missing_slots"),
    )


def missing_slots(outcomes: DataFrame, models: Sequence[str]) -> DataFrame:
    """The (unit, model) slots without an outcome."""
    wanted = outcomes.select(*UNIT).distinct().withColumn("model_name", F.explode(F.array(*[F.lit(m) for m in models])))
    return wanted.join(outcomes.select(*SLOT), list(SLOT), "left_anti")


def validate_outcomes(outcomes: DataFrame, scenarios: DataFrame, models: Sequence[str]) -> DataFrame:
    """Problems as rows (problem, subject, occurrences); an empty result means valid."""
    ids = outcomes.groupBy("outcome_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slots = outcomes.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    unknown_s = (
        outcomes.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n")).join(scenarios.select("scenario_id"), "scenario_id", "left_anti")
    )
    unknown_m = outcomes.groupBy("model_name").agg(F.count(F.lit(1)).alias("n")).where(~F.col("model_name").isin(*models))

    def rows(df: DataFrame, problem: str, subject: Column) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), subject.cast("string").alias("subject"), F.col("n").alias("occurrences"))

    return (
        rows(ids, "duplicate_outcome_id", F.col("outcome_id"))
        .unionByName(rows(slots, "duplicate_slot", joined(*SLOT, sep=":")))
        .unionByName(rows(unknown_s, "unknown_scenario", F.col("scenario_id")))
        .unionByName(rows(unknown_m, "unknown_model", F.col("model_name")))
    )


def run_id(package: str, version: str, role: Column, scenario: Column, seed: Column, namespace: uuid.UUID = EVALUATION_NAMESPACE) -> Column:
    return uuid5(namespace, joined(F.lit("run"), F.lit(package), F.lit(version), role, scenario, seed, sep=":"))


def sample_id(package: str, version: str, model: Column, model_version: Column, run: Column, scenario: Column,
              scenario_version: Column, window_index: Column, event_time: Column, source_ids: Column,
              namespace: uuid.UUID = EVALUATION_NAMESPACE) -> Column:
    """Calibration sample id; source ids are sorted as text, ``none`` without any."""
    ids = F.array_join(F.array_sort(F.transform(source_ids, lambda x: x.cast("string"))), ",")
    ids = F.when(F.coalesce(F.size(source_ids), F.lit(0)) > 0, ids).otherwise(F.lit("none"))
    name = joined(F.lit("calib-sample"), F.lit(package), F.lit(version), model, model_version, run, scenario,
                  scenario_version, window_index, event_time, ids, sep=":")
    return uuid5(namespace, name)


def outcome_id(package: str, version: str, namespace: uuid.UUID = EVALUATION_NAMESPACE) -> Column:
    name = joined(F.lit("outcome"), F.lit(package), F.lit(version), "model_name", "run_id", "scenario_id", "unit_id", sep=":")
    return uuid5(namespace, name)


def split_check(calibration: DataFrame, evaluation: DataFrame, gap_seconds: float = 60.0) -> DataFrame:
    """One row: do the seeds differ and does evaluation start ``gap_seconds`` after the calibration cutoff.

    Both inputs have seed and event_time.
    """
    cal = calibration.agg(F.max("event_time").alias("calibration_end"))
    ev = evaluation.agg(F.min("event_time").alias("evaluation_start"))
    shared = (
        calibration.select("seed").distinct().join(evaluation.select("seed").distinct(), "seed", "left_semi").agg(F.count(F.lit(1)).alias("shared_seeds"))
    )
    gap = (F.unix_micros("evaluation_start") - F.unix_micros("calibration_end")) / F.lit(1_000_000.0)
    return (
        cal.crossJoin(ev)  # three one-row aggregates
        .crossJoin(shared)
        .select(
            "shared_seeds",
            gap.alias("gap_seconds"),
            (F.col("shared_seeds") == 0).alias("seeds_differ"),
            (gap >= gap_seconds).alias("gap_kept"),
        )
    )


def normalise_run(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Replay form of a run: no run id, times as seconds from the run start (six places)."""
    joined_ = lookup_join(events, materialise(starts.select("run_id", "run_start")), ["run_id"], ["event_id"])
    offset = (F.unix_micros("event_time") - F.unix_micros("run_start")) / F.lit(1_000_000.0)
    rest = [c for c in events.columns if c not in ("run_id", "event_time")]
    return joined_.select(*rest, F.round(offset, 6).alias("offset_seconds"))


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one normalised run but not in the other, with multiplicity."""
    columns = left.columns
    both = left.withColumn("_more", F.lit(1)).unionByName(right.withColumn("_more", F.lit(-1)))
    apart = both.groupBy(*columns).agg(F.sum("_more").alias("_more")).where("_more <> 0")
    side = F.when(F.col("_more") > 0, "left").otherwise("right").alias("side")
    return apart.select(*columns, side, F.explode(F.sequence(F.lit(1), F.abs("_more").cast("int")))).drop("col")
