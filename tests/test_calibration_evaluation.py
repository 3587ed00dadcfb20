import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from opsweave.operators import calibration as C
from opsweave.operators import evaluation as E

ANY = dict(supported_models=None, min_samples=3)


def table(spark, rows, ident):
    df = spark.createDataFrame([(i, "m", "1", float(s), t) for i, s, t in rows], f"{ident} long, model_name string, model_version string, score double, t long")
    return df.withColumn("event_time", F.timestamp_seconds("t")).drop("t")


def reference(spark, scores):
    return table(spark, [(1000 + i, s, i) for i, s in enumerate(scores)], "sample_id").withColumn("partition_role", F.lit("calibration"))


def expected(score, ref):
    ref = sorted(ref)
    if ref[0] == ref[-1]:
        return 0.0 if score <= ref[0] else 1.0
    if score <= ref[0]:
        return 0.0
    if score >= ref[-1]:
        return 1.0
    k = bisect_left(ref, score) - 1
    return (k + (score - ref[k]) / (ref[k + 1] - ref[k])) / (len(ref) - 1)


@pytest.mark.parametrize("inline", [0, 10_000])
def test_calibration_equals_a_scan(spark, inline):
    rnd = random.Random(8)
    ref = [round(rnd.random(), 2) for _ in range(150)]
    asks = [round(rnd.random(), 3) for _ in range(200)] + ref[:20] + [0.0, 1.0] + [0.5] * 40
    scores = table(spark, [(i, s, i) for i, s in enumerate(asks)], "source_signal_id")
    out = C.calibrate(scores, reference(spark, ref), C.CalibrationConfig(max_inline_scores=inline, **ANY)).collect()
    assert len(out) == len(asks)
    for r in out:
        assert r.calibrated_score == pytest.approx(expected(r.score, ref))
    ordered = sorted((r.score, r.calibrated_score) for r in out)
    assert all(a[1] <= b[1] for a, b in zip(ordered, ordered[1:]))


def test_degenerate_reference_and_identity(spark):
    scores = table(spark, [(1, 0.2, 0), (2, 0.4, 0), (3, 0.41, 0)], "source_signal_id")
    for method in ("empirical_cdf_percentile", "identity"):
        out = C.calibrate(scores, reference(spark, [0.4] * 5), C.CalibrationConfig(method=method, **ANY)).orderBy("score")
        assert [r.calibrated_score for r in out.collect()] == [0.0, 0.0, 1.0]
    with pytest.raises(Exception, match="degenerate"):
        C.calibrate(scores, reference(spark, [0.4] * 5), C.CalibrationConfig(degenerate="error", **ANY)).collect()


def test_guards(spark):
    ref = reference(spark, [0.1, 0.2, 0.3, 0.4])
    cfg = C.CalibrationConfig(**ANY)
    with pytest.raises(ValueError, match="insufficient"):
        C.fit_calibration(ref, C.CalibrationConfig(supported_models=None, min_samples=5))
    with pytest.raises(ValueError, match="leakage_partition_role"):
        C.fit_calibration(ref.withColumn("partition_role", F.lit("test")), cfg)
    assert C.fit_calibration(ref, cfg, "1970-01-01 00:00:03").count() == 1
    with pytest.raises(ValueError, match="leakage_after_cutoff"):
        C.fit_calibration(ref, cfg, "1970-01-01 00:00:02")
    scores = table(spark, [(1000, 0.2, 0), (None, 0.2, 0), (5, 0.2, 0)], "source_signal_id")
    got = {r.source_signal_id: r.status for r in C.calibrate(scores, ref, cfg).collect()}
    assert got == {1000: "invalid_input", None: "invalid_input", 5: "success"}


def test_calibrated_severity_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.19, 0.2, 0.5, 0.75, 0.9)], "s double")
    assert [r[0] for r in df.select(C.calibrated_severity(F.col("s"))).collect()] == ["debug", "info", "warning", "error", "critical"]
    with pytest.raises(ValueError):
        C.calibrated_severity(F.col("s"), C.CalibrationConfig(bands=(("info", 0.5), ("warning", 0.5))))


# Published counts of three detectors over 240 windows, with their published ratios.
PUBLISHED = [
    ("one", 39, 89, 71, 41, 0.304688, 0.4875, 0.375, 0.55625),
    ("two", 53, 74, 86, 27, 0.417323, 0.6625, 0.512077, 0.4625),
    ("three", 52, 72, 88, 28, 0.419355, 0.65, 0.509804, 0.45),
]


def test_metrics_reproduce_published_ratios(spark):
    df = spark.createDataFrame([r[:5] for r in PUBLISHED], "model_name string, tp long, fp long, tn long, fn long")
    got = {r.model_name: (r.precision, r.recall, r.f1, r.false_positive_rate) for r in E.with_metrics(df).collect()}
    assert got == {r[0]: r[5:] for r in PUBLISHED}


def test_undefined_metrics(spark):
    df = spark.createDataFrame([(0, 0, 4, 0), (0, 2, 0, 3)], "tp long, fp long, tn long, fn long")
    a, b = E.with_metrics(df).orderBy("fp").collect()
    assert (a.precision, a.recall, a.f1, a.f1_detail.status) == (None, None, None, "undefined")
    assert (b.precision, b.recall, b.f1, b.f1_detail.reason) == (0.0, 0.0, None, "zero_denominator: precision + recall == 0.0")


def test_truth_interval_errors(spark):
    rows = [(1, 10.0, 20.0, 30.0), (2, -1.0, 20.0, 30.0), (3, 30.0, None, 30.0), (4, 10.0, 10.0, 30.0), (5, 10.0, 31.0, 30.0), (6, 10.0, None, 30.0)]
    df = spark.createDataFrame(rows, "run_id int, activation_seconds double, recovery_seconds double, total_seconds double")
    out = {r.run_id: r for r in E.truth_intervals(df.withColumn("run_start", F.timestamp_seconds(F.lit(0)))).collect()}
    assert [i for i in out if out[i].error is None] == [1, 6]
    assert out[6].truth_end.second == 30 and out[1].truth_end.second == 20
