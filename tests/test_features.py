import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsweave.operators import features as W
from opsweave.operators.quantiles import exact_quantiles, sliced_quantiles

SCHEMA = "event_id long, s double, metric_name string, value double, service string"
KEYS = ("service",)


def obs(spark, rows):
    """rows: (event_id, seconds, metric, value[, service])"""
    df = spark.createDataFrame([(*r, "a") if len(r) == 4 else r for r in rows], SCHEMA)
    return df.withColumn("event_time", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")


def config(*features, size=10, step=10, **kw):
    return W.FeatureConfig(features, size, step, **kw)


def windows(spark, rows, cfg):
    return W.extract(obs(spark, rows), cfg, KEYS).orderBy("window_index").collect()


def test_aggregate_golden_values(spark):
    rows = [(i, float(i), "d", v) for i, v in enumerate([10.0, 20.0, 30.0, 40.0, 50.0])]
    cfg = config(*[f"d:{a}" for a in W.AGGREGATES])
    (w,) = windows(spark, rows, cfg)
    want = dict(mean=30, median=30, p50=30, p90=46, p95=48, p99=49.6, min=10, max=50, sum=150, count=5, rate=0.5, std=math.sqrt(250), stddev=math.sqrt(250), first=10, last=50)
    assert {a: pytest.approx(w[f"d__{a}"]) for a in want} == want


def test_window_edges_are_half_open(spark):
    cfg = config("d:count", size=10, step=5, imputation="none")
    ws = windows(spark, [(0, 0.0, "d", 1.0), (1, 5.0, "d", 1.0), (2, 10.0, "d", 1.0)], cfg)
    assert [(w.window_index, w.d__count) for w in ws] == [(0, 2.0), (1, 2.0), (2, 1.0)]


def test_windows_match_a_brute_force_scan(spark):
    rnd = random.Random(5)
    rows = [(i, round(rnd.uniform(0, 300), 6), "d", float(i)) for i in range(120)]
    cfg = config("d:sum", size=17, step=4, imputation="none")
    got = {w.window_index: w.d__sum for w in windows(spark, rows, cfg)}
    times = [(round(r[1] * 1e6), r[3]) for r in rows]
    origin, last = min(times)[0], max(times)[0]
    want, i = {}, 0
    while origin + i * 4_000_000 <= last:
        lo = origin + i * 4_000_000
        inside = [v for t, v in times if lo <= t < lo + 17_000_000]
        want[i] = sum(inside) if inside else None
        i += 1
    assert got == want


def test_input_order_does_not_matter(spark):
    rows = [(i, i * 1.5, "d", float(i % 7)) for i in range(40)]
    cfg = config("d:mean", "d:last", size=6, step=3)
    plain = windows(spark, rows, cfg)
    random.Random(1).shuffle(rows)
    assert windows(spark, rows, cfg) == plain


def test_dedupe_keeps_the_earliest_copy(spark):
    df = obs(spark, [(1, 5.0, "d", 9.0), (1, 2.0, "d", 7.0), (1, 3.0, "e", 1.0)])
    kept = {(r.metric_name, r.value) for r in W.dedupe_observations(df).collect()}
    assert kept == {("d", 7.0), ("e", 1.0)}


def test_dedupe_cuts_copies_before_the_shuffle(spark):
    plan = W.dedupe_observations(obs(spark, [(1, 5.0, "d", 9.0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_forward_fill_and_status(spark):
    rows = [(0, 0.0, "d", 4.0), (1, 25.0, "e", 1.0), (2, 35.0, "d", 0.0), (3, 36.0, "e", 2.0)]
    ws = windows(spark, rows, config("d:mean", "e:mean", warm_up_windows=1))
    assert [(w.d__mean, w.e__mean, w.status) for w in ws] == [
        (4.0, 0.0, "warmup"), (4.0, 0.0, "imputed"), (4.0, 1.0, "imputed"), (0.0, 2.0, "complete")]
    assert [sorted(w.imputed_features) for w in ws] == [["e__mean"], ["d__mean", "e__mean"], ["d__mean"], []]


def test_none_leaves_gaps_and_zero_is_a_value(spark):
    rows = [(0, 0.0, "d", 0.0), (1, 25.0, "d", 3.0)]
    ws = windows(spark, rows, config("d:mean", imputation="none"))
    assert [(w.d__mean, w.status) for w in ws] == [(0.0, "complete"), (None, "empty"), (3.0, "complete")]


def test_low_sample_count_stays_insufficient(spark):
    ws = windows(spark, [(0, 0.0, "d", 1.0)], config("d:mean", min_samples=2))
    assert [w.status for w in ws] == ["insufficient_data"]


def test_linear_interpolation(spark):
    ws = windows(spark, [(0, 0.0, "d", 1.0), (1, 30.0, "d", 4.0)], config("d:mean", imputation="linear_interpolate"))
    assert [w.d__mean for w in ws] == [1.0, 2.0, 3.0, 4.0]


def test_long_gap_is_filled(spark):
    ws = W.extract(obs(spark, [(0, 0.0, "d", 1.0), (1, 100_000.0, "d", 2.0)]), config("d:mean"), KEYS)
    assert ws.count() == 10_001 and ws.where("status = 'imputed'").count() == 9_999


def test_hot_series_takes_the_sliced_path_with_equal_results(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.uniform(0, 50), "d", rnd.choice([1.0, 2.5, rnd.random()]), "hot" if i % 3 else "cold") for i in range(300)]
    plain = W.extract(obs(spark, rows), config("d:p50", "d:p99", "d:mean"), KEYS)
    hot = W.extract(obs(spark, rows), config("d:p50", "d:p99", "d:mean", hot_rows=150), KEYS)
    cols = ["service", "window_index", "d__p50", "d__p99"]
    shape = lambda df: sorted((r[0], r[1], round(r[2], 9), round(r[3], 9)) for r in df.select(*cols).collect())
    assert shape(hot) == shape(plain)


@pytest.mark.parametrize("keys", [["k"], []])
def test_sliced_quantiles_equal_numpy(spark, keys):
    rnd = random.Random(3)
    rows = [(rnd.choice("xy") if keys else "x", rnd.choice([0.0, 1.0, rnd.gauss(0, 1)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.25, 0.5, 0.95, 1.0]
    for fn in (lambda: sliced_quantiles(df, keys, "v", qs), lambda: exact_quantiles(df, keys, "v", qs, "quantiles", hot_rows=100)):
        for r in fn().collect():
            values = [v for k, v in rows if not keys or k == r["k"]]
            assert r["quantiles"] == pytest.approx(list(np.quantile(values, qs)))


def test_exports_reject_incomplete_rows(spark):
    ws = W.extract(obs(spark, [(0, 0.0, "d", 1.0), (1, 25.0, "d", 3.0)]), config("d:mean", imputation="none"), KEYS)
    with pytest.raises(Exception, match="incomplete feature vector"):
        W.to_matrix(ws, ["d__mean"]).collect()
    with pytest.raises(Exception, match="missing target"):
        W.to_series(ws, "d__mean").collect()
    matrix = W.to_matrix(ws, ["d__mean"], allow_incomplete=True)
    assert [r.sequence for r in W.to_sequences(matrix, 2, KEYS).collect()] == [[[1.0], [3.0]]]


@pytest.mark.parametrize("bad", [dict(size=5, step=6), dict(step=0), dict(imputation="guess"), dict(alignment="left")])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        config("d:mean", **bad)


@pytest.mark.parametrize("decl", [":mean", "d:", "d:mode"])
def test_feature_declarations_are_checked(decl):
    with pytest.raises(ValueError):
        config(decl)
