import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsweave.operators import causal, detectors as D, forest, reconstruct

KEYS = ("service",)


def series(spark, values, **more):
    rows = [("a", i, v, *[more[m][i] for m in more]) for i, v in enumerate(values)]
    cols = "service string, window_index long, y double" + "".join(f", {m} double" for m in more)
    df = spark.createDataFrame(rows, cols)
    at = F.timestamp_micros(F.col("window_index") * 1_000_000)
    return df.withColumn("observation_timestamp", at).withColumn("window_start", at).withColumn("window_end", at)


def test_linear_forecast_equals_least_squares(spark):
    rnd = random.Random(4)
    y = [3 + 0.5 * i + rnd.gauss(0, 1) for i in range(25)]
    rows = D.forecast_residual(series(spark, y), D.ForecastConfig("y", min_history=5), KEYS).orderBy("window_index").collect()
    for i in range(5, 25):
        slope, intercept = np.polyfit(range(i), y[:i], 1)
        assert rows[i].expected == pytest.approx(intercept + slope * i)
        fit = intercept + slope * np.arange(i)
        sd = math.sqrt(((np.array(y[:i]) - fit) ** 2).sum() / (i - 2))
        scale = max(1.959963984540054 * sd, np.std(y[:i], ddof=1), 0.01 * max(abs(rows[i].expected), 1), 1e-4)
        assert rows[i].anomaly_score == pytest.approx(1 - math.exp(-abs(y[i] - rows[i].expected) / scale / 3))
    assert {r.status for r in rows[:5]} == {"insufficient_history"}


def test_regressor_forecast_equals_least_squares(spark):
    rnd = random.Random(6)
    x = [rnd.uniform(0, 10) for _ in range(20)]
    y = [1 + 0.2 * i + 3 * x[i] + rnd.gauss(0, 0.1) for i in range(20)]
    rows = D.forecast_residual(series(spark, y, x=x), D.ForecastConfig("y", ("x",), min_history=6), KEYS).orderBy("window_index").collect()
    for i in range(6, 20):
        a = np.column_stack([np.ones(i), np.arange(i), x[:i]])
        beta = np.linalg.lstsq(a, np.array(y[:i]), rcond=None)[0]
        assert rows[i].expected == pytest.approx(float(beta @ [1, i, x[i]]), rel=1e-6)


def test_flat_series_scores_zero(spark):
    rows = D.forecast_residual(series(spark, [5.0] * 8), D.ForecastConfig("y", min_history=3), KEYS).collect()
    assert {r.anomaly_score for r in rows if r.status == "success"} == {0.0}


def test_severity_edges(spark):
    df = spark.createDataFrame([(0.49,), (0.5,), (0.75,), (0.9,)], "s double")
    assert [r[0] for r in df.select(D.detector_severity(F.col("s"))).collect()] == ["info", "warning", "error", "critical"]


def test_isolation_forest_finds_the_outlier_and_repeats(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, "m", [float(v) for v in rnd.normal(0, 1, 3)]) for i in range(300)] + [(999, "m", [9.0, -9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, model string, vector array<double>")
    model = forest.fit_forest(df, ["model"], "id", trees=40)
    out = {r.id: r.raw_score for r in forest.score_forest(df, model, ["model"], "id").collect()}
    assert min(out, key=out.get) == 999 and all(-1 <= s < 0 for s in out.values())
    again = forest.fit_forest(df.repartition(7), ["model"], "id", trees=40)
    assert out == {r.id: r.raw_score for r in forest.score_forest(df, again, ["model"], "id", slices=3).collect()}


def test_reconstruction_equals_numpy_pca(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(0, 1, (80, 4)) @ np.diag([3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    fit = reconstruct.fit_reconstruction(df, [], 4, bottleneck=2)
    got = {r.id: r.raw_score for r in reconstruct.reconstruction_error(df, fit, [], "id").collect()}
    centred = x - x.mean(axis=0)
    _, vec = np.linalg.eigh(np.cov(centred.T, bias=True))
    top = vec[:, ::-1][:, :2]
    want = ((centred - centred @ top @ top.T) ** 2).mean(axis=1)
    assert [got[i] for i in range(80)] == pytest.approx(list(want))


@pytest.mark.parametrize("model", ["isolation_forest", "reconstruction"])
def test_causal_scores_use_only_the_past(spark, model):
    rnd = random.Random(7)
    a, b = [rnd.gauss(0, 1) for _ in range(24)], [rnd.gauss(0, 1) for _ in range(24)]
    short = causal.score_causal(series(spark, a[:18], z=b[:18]), ["y", "z"], KEYS, model, refit_every=4, min_history=4, trees=10)
    full = causal.score_causal(series(spark, a, z=b), ["y", "z"], KEYS, model, refit_every=4, min_history=4, trees=10)
    left = {r.window_index: (r.status, r.anomaly_score) for r in short.collect()}
    right = {r.window_index: (r.status, r.anomaly_score) for r in full.where("window_index < 18").collect()}
    assert left.keys() == right.keys()
    for i in left:
        assert left[i][0] == right[i][0]
        if left[i][1] is not None:
            assert left[i][1] == pytest.approx(right[i][1])
            assert 0.0 <= left[i][1] <= 1.0
    assert left[0][0] == "insufficient_history"


def test_regressor_forecast_far_from_zero_and_dependent(spark):
    """Centred moments keep their digits, and a regressor that repeats another changes nothing."""
    rnd = random.Random(16)
    x = [1e6 + rnd.uniform(0, 10) for _ in range(24)]
    y = [1e7 + 0.2 * i + 3 * x[i] + rnd.gauss(0, 0.1) for i in range(24)]
    rows = D.forecast_residual(series(spark, y, x=x), D.ForecastConfig("y", ("x",), min_history=6), KEYS).orderBy("window_index").collect()
    twice = D.forecast_residual(series(spark, y, x=x, z=x), D.ForecastConfig("y", ("x", "z"), min_history=6), KEYS).orderBy("window_index").collect()
    for i in range(8, 24):
        a = np.column_stack([np.ones(i), np.arange(i) - i / 2, np.array(x[:i]) - 1e6])
        beta = np.linalg.lstsq(a, np.array(y[:i]) - 1e7, rcond=None)[0]
        want = 1e7 + float(beta @ [1, i - i / 2, x[i] - 1e6])
        assert rows[i].expected == pytest.approx(want, abs=1e-4) and twice[i].expected == pytest.approx(want, abs=1e-3)


def test_signal_sources_join_signals_and_provenance(spark):
    y = [5.0 + (i % 3) for i in range(9)]
    scores = D.forecast_residual(series(spark, y), D.ForecastConfig("y", min_history=4), KEYS)
    members = spark.createDataFrame([("a", i, 10 * i + j, "m") for i in range(9) for j in range(i % 4)] + [("b", 5, 999, "m")], "service string, window_index long, event_id long, metric_name string")
    got = {(r.signal_id, r.event_id) for r in D.signal_sources(scores, members, KEYS).collect()}
    ids = {r.window_end.timestamp(): r.signal_id for r in D.to_signals(scores, "y", KEYS, "forecast_residual").select("window_end", "signal_id").collect()}
    assert got == {(ids[i], 10 * i + j) for i in range(4, 9) for j in range(i % 4)}
