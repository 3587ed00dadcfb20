"""Quantiles over prefixes against sorting each past."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from opsweave.operators import detectors, prefix_order as O

QUANTILES = (0.0, 0.25, 0.5, 0.9)


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(37)), st.lists(st.tuples(st.integers(1, 37), st.integers(0, 36)), min_size=1, max_size=30))
def test_kth_of_prefixes(ranks, questions):
    length = np.array([n for n, _ in questions])
    k = np.array([min(k, n - 1) for n, k in questions])
    assert O.kth_of_prefixes(np.array(ranks), length, k).tolist() == [sorted(ranks[:n])[i] for n, i in zip(length, k)]


def rows_of(seed, n=150):
    rng = np.random.default_rng(seed)
    out = []
    for name, far in (("a", 0.0), ("b", 1e6), (None, 0.0)):
        for i in range(n if name else 20):
            x = None if rng.random() < 0.2 else float(rng.integers(0, 12)) + far  # many ties
            y = float(rng.normal())
            out.append((name, i + 5, x, y))
    return out


@pytest.mark.parametrize("slice_size", [7, 64, 16384])
def test_equals_sorting_each_past(spark, slice_size):
    rows = rows_of(slice_size)
    df = spark.createDataFrame(rows, "service string, window_index long, x double, y double").repartition(5)
    out = O.prefix_quantiles(df, ["service"], {"x": F.col("x"), "y": F.col("y")}, QUANTILES, slice_size).collect()
    assert len(out) == len(rows)
    for r in out:
        for place, c in enumerate(("x", "y")):
            past = [row[2 + place] for row in rows if row[0] == r.service and row[1] < r.window_index and row[2 + place] is not None]
            got = [r[f"{c}__q{i}"] for i in range(len(QUANTILES))]
            assert got == (pytest.approx(np.quantile(past, QUANTILES).tolist()) if past else [None] * len(QUANTILES))


def test_long_series_spreads_over_tasks(spark):
    """No group holds more than a slice or a bucket, also where all questions meet the middle."""
    n, size = 3000, 100
    df = spark.range(n).select(F.lit("a").alias("service"), F.col("id").alias("window_index"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("x"))
    out = {r.window_index: r.x__q0 for r in O.prefix_quantiles(df, ["service"], {"x": F.col("x")}, (0.5,), size).select("window_index", "x__q0").collect()}
    values = [r.x for r in df.orderBy("window_index").collect()]
    assert out[0] is None and all(out[t] == pytest.approx(float(np.median(values[:t]))) for t in range(1, n, 37))


def test_defined_cases(spark):
    schema = "service string, window_index long, x double"
    empty = O.prefix_quantiles(spark.createDataFrame([], schema), ["service"], {"x": F.col("x")}, (0.5,))
    assert empty.count() == 0 and empty.columns == ["service", "window_index", "x", "x__q0"]
    missing = spark.createDataFrame([("a", i, None) for i in range(4)], schema)
    assert [r.x__q0 for r in O.prefix_quantiles(missing, ["service"], {"x": F.col("x")}, (0.5,)).collect()] == [None] * 4
    nan = spark.createDataFrame([("a", 0, float("nan")), ("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)], schema)
    got = {r.window_index: r.x__q0 for r in O.prefix_quantiles(nan, ["service"], {"x": F.col("x")}, (0.0,)).collect()}
    assert got[2] == 1.0 and got[3] == 1.0 and got[0] is None and got[1] is None


def test_robust_scaling(spark):
    rows = [("a", i, float(v), float(i)) for i, v in enumerate([5, 1, 4, 4, 9, 2])]
    df = spark.createDataFrame(rows, "service string, window_index long, y double, z double")
    out = detectors.scale_features(df, ["y", "z"], ["service"], "robust").orderBy("window_index").collect()
    past = [5, 1, 4, 4, 9]
    q = np.quantile(past, [0.25, 0.5, 0.75])
    assert out[5].y__center == q[1] and out[5].y__scale == q[2] - q[0] and out[5].y__scaled == pytest.approx((2 - q[1]) / (q[2] - q[0]))
    assert out[0].y__center is None and out[0].y__scale == 1.0
