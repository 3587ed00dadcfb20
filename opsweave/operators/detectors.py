"""Causal detectors over feature windows: forecast residual, scaling, tail scores, signals.

Every window is scored against earlier complete windows of its own series only, so
all history is an expanding frame that ends one row before the scored window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from opsweave.functions.identity import SIGNAL_NAMESPACE, joined, uuid5
from opsweave.functions.numeric import DETECTOR_BANDS, clamp, is_finite, severity_from_score
from opsweave.functions.skew import lookup_join
from opsweave.operators.prefix_order import prefix_quantiles
from opsweave.session import materialise

# Two-sided standard normal quantile by interval width.
NORMAL_QUANTILE = {0.80: 1.2815515655446004, 0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


@dataclass(frozen=True)
class ForecastConfig:
    target: str
    regressors: tuple[str, ...] = ()
    min_history: int = 10
    interval_width: float = 0.95
    growth: str = "linear"
    scale_factor: float = 3.0
    epsilon: float = 1e-4
    model_name: str = "forecast"
    model_version: str = "1.0.0"

    def __post_init__(self) -> None:
        if self.growth not in ("linear", "flat"):
            raise ValueError("growth must be linear or flat")
        if self.interval_width not in NORMAL_QUANTILE:
            raise ValueError(f"interval_width must be one of {sorted(NORMAL_QUANTILE)}")


def history_frame(keys: Sequence[str], order: str = "window_index"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def residual_score(observed: Column, expected: Column, lower: Column, upper: Column, hist_std: Column,
                   scale_factor: float = 3.0, epsilon: float = 1e-4) -> Column:
    """Saturating score of a forecast residual.

    0 for no deviation, else 1 - exp(-(deviation/scale)/scale_factor), where scale is
    the largest of: half band, historic sample deviation, 1 % of |expected| (at least
    0.01), epsilon.
    """
    dev = F.abs(observed - expected)
    band = F.greatest(upper - expected, expected - lower, F.lit(0.0))
    scale = F.greatest(
        band, hist_std, F.lit(0.01) * F.greatest(F.abs(expected), F.lit(1.0)), F.lit(epsilon)
    )
    return F.when(dev == 0, F.lit(0.0)).otherwise(clamp(1 - F.exp(-(dev / scale) / F.lit(scale_factor))))


def detector_severity(score: Column) -> Column:
    """critical from .90, error from .75, warning from .50, else info."""
    return severity_from_score(score, DETECTOR_BANDS, "info")


def forecast_residual(windows: DataFrame, cfg: ForecastConfig, keys: Sequence[str]) -> DataFrame:
    """Expected value and band from causal history, residual score and status per window.

    ``linear`` growth fits a least-squares line on the window index, ``flat`` uses the
    mean; regressors are added as further linear terms.  The band is the normal
    quantile of ``interval_width`` times the residual deviation of the fit.
    """
    ready = F.col(cfg.target).isNotNull()
    for r in cfg.regressors:
        ready = ready & F.col(r).isNotNull()
    frame = history_frame(keys)
    y = F.when(ready, F.col(cfg.target))
    x = F.when(ready, F.col("window_index").cast("double"))
    hist = windows.withColumn("history_windows", F.count(y).over(frame)).withColumn(
        "history_std", F.coalesce(F.stddev_samp(y).over(frame), F.lit(0.0))
    )
    n = F.col("history_windows").cast("double")
    if cfg.regressors:
        fitted = _fit_with_regressors(hist, cfg, keys, ready)
    elif cfg.growth == "flat":
        fitted = hist.withColumn("expected", F.avg(y).over(frame)).withColumn(
            "_resid_sd", F.coalesce(F.stddev_samp(y).over(frame), F.lit(0.0))
        )
    else:
        sxx, syy, sxy = F.regr_sxx(y, x).over(frame), F.regr_syy(y, x).over(frame), F.regr_sxy(y, x).over(frame)
        moments = (
            hist.withColumn("_sxx", sxx)
            .withColumn("_syy", syy)
            .withColumn("_sxy", sxy)
            .withColumn("_mx", F.avg(x).over(frame))
            .withColumn("_my", F.avg(y).over(frame))
        )
        slope = F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")).otherwise(F.lit(0.0))
        sse = F.greatest(F.col("_syy") - slope * F.col("_sxy"), F.lit(0.0))
        fitted = (
            moments.withColumn("expected", F.col("_my") + slope * (F.col("window_index") - F.col("_mx")))
            .withColumn("_resid_sd", F.when(n > 2, F.sqrt(sse / (n - 2))).otherwise(F.lit(0.0)))
            .drop("_sxx", "_syy", "_sxy", "_mx", "_my")
        )
    half = F.lit(NORMAL_QUANTILE[cfg.interval_width]) * F.col("_resid_sd")
    banded = fitted.withColumn("lower", F.col("expected") - half).withColumn("upper", F.col("expected") + half)
    status = forecast_status(F.col(cfg.target), ready, F.col("history_windows"), F.col("expected"), cfg.min_history)
    scored = banded.withColumn("status", status)
    good = F.col("status") == "success"
    score = residual_score(
        F.col(cfg.target), F.col("expected"), F.col("lower"), F.col("upper"), F.col("history_std"), cfg.scale_factor, cfg.epsilon
    )
    result = scored.withColumn("anomaly_score", F.when(good, score))
    for c in ("expected", "lower", "upper"):
        result = result.withColumn(c, F.when(good, F.col(c)))
    return (
        result.withColumn("observed", F.col(cfg.target))
        .withColumn("residual", F.col("observed") - F.col("expected"))
        .withColumn("raw_score", F.abs("residual"))
        .withColumn("severity", detector_severity(F.col("anomaly_score")))
        .withColumn("model_name", F.lit(cfg.model_name))
        .withColumn("model_version", F.lit(cfg.model_version))
        .drop("_resid_sd")
    )


def forecast_status(target: Column, ready: Column, history: Column, expected: Column, min_history: int) -> Column:
    """missing_target_value, invalid_input, insufficient_history, fit_failure or success, in this order."""
    return (
        F.when(~ready, "missing_target_value")
        .when(~is_finite(target), "invalid_input")
        .when(history < min_history, "insufficient_history")
        .when(~is_finite(expected), "fit_failure")
        .otherwise("success")
    )


def _fit_with_regressors(hist: DataFrame, cfg: ForecastConfig, keys: Sequence[str], ready: Column) -> DataFrame:
    """Least squares on centred moments of the history, solved for a batch of windows at once.

    Means and covariances stay in Spark as expanding aggregates, which are centred and so
    keep their digits far from zero; Python sees one k x k system per window.  Terms are
    scaled to unit deviation; constant or dependent ones share their part (pseudo-inverse).
    """
    frame = history_frame(keys)
    # A cell holds the value only where the row may enter the history.
    terms = [*([F.col("window_index").cast("double")] if cfg.growth == "linear" else []), *[F.col(r).cast("double") for r in cfg.regressors]]
    known = [F.when(ready, t) for t in terms]
    y = F.when(ready, F.col(cfg.target).cast("double"))
    k = len(terms)
    gram = F.array(*[F.covar_pop(known[i], known[j]).over(frame) for i in range(k) for j in range(k)])
    cross = F.array(*[F.covar_pop(t, y).over(frame) for t in known])
    apart = F.array(*[t - F.avg(v).over(frame) for t, v in zip(terms, known)])
    sums = hist.select("*", gram.alias("_g"), cross.alias("_b"), F.var_pop(y).over(frame).alias("_yy"), F.avg(y).over(frame).alias("_my"), apart.alias("_x"))

    @F.pandas_udf("struct<expected: double, sd: double>")
    def solve(g: pd.Series, b: pd.Series, yy: pd.Series, my: pd.Series, x: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = np.full((len(g), 2), np.nan)
        cells = np.array([np.concatenate([np.asarray(v, float) for v in row]) for row in zip(g, b, x)]).reshape(len(g), k * k + 2 * k)
        usable = np.flatnonzero((n.to_numpy() > k + 1) & np.isfinite(cells).all(axis=1))
        if len(usable):
            matrix, right, at = cells[usable, : k * k].reshape(-1, k, k), cells[usable, k * k : k * k + k], cells[usable, k * k + k :]
            scale = np.sqrt(np.einsum("nii->ni", matrix))
            scale = np.where(scale > 0, scale, 1.0)
            inverse = np.linalg.pinv(matrix / scale[:, :, None] / scale[:, None, :], rcond=1e-12, hermitian=True)
            beta = np.einsum("nij,nj->ni", inverse, right / scale) / scale
            count = n.to_numpy()[usable]
            sse = np.maximum(count * (yy.to_numpy()[usable] - (beta * right).sum(axis=1)), 0.0)
            out[usable, 0] = my.to_numpy()[usable] + (beta * at).sum(axis=1)
            out[usable, 1] = np.sqrt(sse / (count - k - 1))
        return pd.DataFrame(out, columns=["expected", "sd"])

    fit = sums.withColumn("_fit", solve("_g", "_b", "_yy", "_my", "_x", F.col("history_windows").cast("double")))
    return (
        fit.withColumn("expected", F.col("_fit.expected"))
        .withColumn("_resid_sd", F.coalesce(F.nanvl(F.col("_fit.sd"), F.lit(0.0)), F.lit(0.0)))
        .drop("_fit", "_g", "_b", "_yy", "_my", "_x")
    )


def scale_features(windows: DataFrame, columns: Sequence[str], keys: Sequence[str], method: str = "standard") -> DataFrame:
    """Adds ``<c>__center``, ``<c>__scale`` and ``<c>__scaled`` from causal history.

    standard: mean and sample deviation; robust: median and IQR; minmax: minimum and
    range; none: 0 and 1.  A scale under 1e-8 (or without history) becomes 1.
    Only windows with all columns present enter the history.
    """
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    frame = history_frame(keys)
    out = windows.withColumn("history_windows", F.count(F.when(complete, F.lit(1))).over(frame))
    if method == "robust":
        out = _robust_history(out.withColumn("_complete", complete), columns, keys).drop("_complete")
    for c in columns:
        v = F.when(complete, F.col(c))
        center, spread = f"{c}__center", f"{c}__scale"
        if method == "standard":
            out = out.withColumn(center, F.avg(v).over(frame)).withColumn(spread, F.stddev_samp(v).over(frame))
        elif method == "minmax":
            out = out.withColumn(center, F.min(v).over(frame)).withColumn(
                spread, F.max(v).over(frame) - F.min(v).over(frame)
            )
        elif method == "none":
            out = out.withColumn(center, F.lit(0.0)).withColumn(spread, F.lit(1.0))
        elif method != "robust":
            raise ValueError(f"unknown scaling method {method!r}")
        out = out.withColumn(spread, F.when(F.col(spread) >= 1e-8, F.col(spread)).otherwise(F.lit(1.0)))
        out = out.withColumn(f"{c}__scaled", (F.col(c) - F.col(center)) / F.col(spread))
    return out


def _robust_history(windows: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Median and IQR of everything before each window, by ranks over prefixes."""
    values = {c: F.when(F.col("_complete"), F.col(c)) for c in columns}
    ranked = prefix_quantiles(windows, keys, values, (0.25, 0.5, 0.75))
    for c in columns:
        ranked = ranked.withColumn(f"{c}__center", F.col(f"{c}__q1")).withColumn(f"{c}__scale", F.col(f"{c}__q2") - F.col(f"{c}__q0"))
    return ranked.drop(*[f"{c}__q{i}" for c in columns for i in range(3)])


def tail_score(raw: Column, low: Column, mean: Column, std: Column, constant_match: Column,
               scale_factor: float, epsilon: float, floor: float) -> Column:
    """Position of a raw score against its training scores (higher = more anomalous).

    0 up to the training minimum or for a target equal to constant training data;
    linear to 0.30 at the training mean; above it saturates towards 1.
    """
    linear = clamp(F.lit(0.30) * (raw - low) / F.greatest(mean - low, F.lit(floor)), 0.0, 0.30)
    excess = F.lit(0.30) + F.lit(0.70) * (
        1 - F.exp(-(raw - mean) / F.greatest(std * F.lit(scale_factor), F.lit(epsilon)))
    )
    return (
        F.when(constant_match, F.lit(0.0))
        .when(raw <= low, F.lit(0.0))
        .when(raw <= mean, linear)
        .otherwise(clamp(excess))
    )


# Tail-score parameters of the two multivariate detectors.
FOREST_TAIL = {"scale_factor": 2.0, "epsilon": 0.05, "floor": 0.01}
RECONSTRUCTION_TAIL = {"scale_factor": 3.0, "epsilon": 1e-4, "floor": 1e-4}


def multivariate_status(missing: Column, finite: Column, history: Column, raw: Column, min_history: int) -> Column:
    """missing_features, invalid_input, insufficient_history, fit_failure or success, in this order."""
    return (
        F.when(missing, "missing_features")
        .when(~finite, "invalid_input")
        .when(history < min_history, "insufficient_history")
        .when(~is_finite(raw), "fit_failure")
        .otherwise("success")
    )


SIGNAL_COLUMNS = (
    "signal_id event_time service metric_or_feature model_name model_version anomaly_score severity evidence "
    "run_id scenario_id scenario_version seed reproducibility_key window_start window_end environment tenant_id tags"
).split()


def _signal_id(keys: Sequence[str]) -> Column:
    return uuid5(SIGNAL_NAMESPACE, joined("model_name", "model_version", *keys, "window_index"))


def signal_sources(scores: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(signal_id, event_id, metric_name): the events behind each signal, from the provenance table.

    A table instead of an array in the signal: the ids of a hot window are spread by event
    id and never meet in one row.  Windows without a signal have no rows; an empty
    window's signal has none either.
    """
    place = [*keys, "window_index"]
    ids = materialise(scores.where("status = 'success'").select(*place, _signal_id(keys).alias("signal_id")))
    return lookup_join(members.select(*place, "event_id", "metric_name"), ids, place, ["event_id"]).select("signal_id", "event_id", "metric_name")


def to_signals(scores: DataFrame, metric: str, keys: Sequence[str], evidence_type: str) -> DataFrame:
    """Successful score rows as signal records with one evidence struct each.

    The id is name-based on (model, version, series, window), so a replay mints the
    same signal.  Missing run-context columns get the documented defaults.
    """
    have = set(scores.columns)

    def col(name: str, default: object) -> Column:
        return F.col(name) if name in have else F.lit(default)

    evidence = F.struct(
        F.lit(evidence_type).alias("evidence_type"),
        F.lit(metric).alias("metric_or_feature"),
        col("observed", None).cast("double").alias("observed_value"),
        col("expected", None).cast("double").alias("expected_value"),
        col("residual", None).cast("double").alias("deviation"),
        F.create_map(
            F.lit("raw_score"), F.col("raw_score").cast("string"),
            F.lit("history_windows"), col("history_windows", None).cast("string"),
        ).alias("details"),
        F.col("observation_timestamp").alias("timestamp"),
    )
    return scores.where("status = 'success'").select(
        _signal_id(keys).alias("signal_id"),
        F.col("observation_timestamp").alias("event_time"),
        col("service", "unknown").alias("service"),
        F.lit(metric).alias("metric_or_feature"),
        "model_name",
        "model_version",
        "anomaly_score",
        "severity",
        F.array(evidence).alias("evidence"),
        col("run_id", "0").alias("run_id"),
        col("scenario_id", "unknown").alias("scenario_id"),
        col("scenario_version", "1.0.0").alias("scenario_version"),
        col("seed", 0).alias("seed"),
        col("reproducibility_key", "default").alias("reproducibility_key"),
        "window_start",
        "window_end",
        col("environment", "default").alias("environment"),
        col("tenant_id", "default").alias("tenant_id"),
        F.create_map(F.lit("model"), F.col("model_name"), F.lit("target"), F.lit(metric)).alias("tags"),
    )
