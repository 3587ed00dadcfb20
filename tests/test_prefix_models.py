"""A model per window: equal to a direct fit of every prefix, whatever the packs and blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsweave.operators import causal, detectors, forest, prefix_models as P

COLUMNS = ["y", "z", "w"]


def frame(spark, x):
    rows = [("a", i, *[None if v is None else float(v) for v in r]) for i, r in enumerate(x)]
    rows += [("b", i, float(i), 1.0, -float(i)) for i in range(9)]
    return spark.createDataFrame(rows, "service string, window_index long, y double, z double, w double")


def walk(n, seed=1, holes=()):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) @ np.array([[2.0, 0.3, 0], [0, 1, 0.5], [0, 0, 0.2]])
    return [[None, 1.0, 2.0] if i in holes else r.tolist() for i, r in enumerate(x)]


def summary(scores, sign):
    s = sign * np.asarray(scores)
    return s.min(), s.mean(), s.std(ddof=1) if len(s) > 1 else 0.0


@pytest.mark.parametrize("scaling,shift", [("standard", 0.0), ("minmax", 0.0), ("none", 0.0), ("standard", 1e7)])
def test_reconstruction_equals_a_direct_fit(spark, scaling, shift):
    x = [[None if v is None else v + shift for v in r] for r in walk(70, holes=(3, 33, 34, 60))]
    model = P.Reconstruction(3, bottleneck=2, scaling=scaling)
    rows = P.score_prefixes(frame(spark, x), COLUMNS, ["service"], model, min_history=5, pack=16, block=4).where("service = 'a'").orderBy("window_index").collect()
    assert [r.window_index for r in rows] == list(range(70))
    for t, r in enumerate(rows):
        train = np.array([v for v in x[:t] if v[0] is not None], float).reshape(-1, 3)
        assert r.history_windows == len(train)
        if len(train) < 5 or x[t][0] is None:
            assert r.raw_score is None and r._mean is None
            continue
        spread = {"standard": train.std(axis=0, ddof=1), "minmax": np.ptp(train, axis=0), "none": np.ones(3)}[scaling]
        scaled = (train - train.mean(axis=0)) / spread
        _, vectors = np.linalg.eigh(np.cov(scaled.T, bias=True))
        top = vectors[:, 1:]
        error = lambda d: ((d - d @ top @ top.T) ** 2).mean(axis=-1)
        assert r.raw_score == pytest.approx(error((np.array(x[t]) - train.mean(axis=0)) / spread), rel=1e-5, abs=1e-9)
        assert (r._min, r._mean, r._std) == pytest.approx(summary(error(scaled), 1), rel=1e-5, abs=1e-9)


def direct_forest(settings, train, target):
    draw = forest.uniform(settings.seed, np.arange(settings.trees)[:, None], np.array([i for i, _ in train])[None, :], 2)
    x = np.array([v for _, v in train])
    order = np.argsort(draw, axis=1)[:, : settings.max_samples]
    slots = forest.drawn_slots(settings, len(train))
    sample = np.array([x[o][s] for o, s in zip(order, slots)])
    grown = forest.grow_trees(sample, np.arange(settings.trees), settings)
    scores = lambda r: forest.forest_scores(grown.depths(np.atleast_2d(r)), slots.shape[1])
    return slots.shape[1], scores(target)[0], scores(x)


@pytest.mark.parametrize("more", [{}, {"bootstrap": True}, {"max_features": 0.5}])
def test_forest_equals_a_direct_fit(spark, more):
    x = walk(75, seed=4, holes=(2, 40))
    settings = forest.ForestSettings(trees=12, max_samples=16, seed=7, **more)
    found = P.score_prefixes(frame(spark, x), COLUMNS, ["service"], P.IsolationForest(settings), min_history=4, contamination=0.1, pack=32, block=8)
    rows = found.where("service = 'a'").orderBy("window_index").collect()
    for t, r in enumerate(rows):
        train = [(i, v) for i, v in enumerate(x[:t]) if v[0] is not None]
        assert r.history_windows == len(train)
        if len(train) < 4 or x[t][0] is None:
            assert r.raw_score is None and r.sample_size is None
            continue
        size, raw, scores = direct_forest(settings, train, x[t])
        assert r.sample_size == size == min(16, len(train)) and r.raw_score == pytest.approx(raw, rel=1e-12)
        assert (r._min, r._mean, r._std) == pytest.approx(summary(scores, -1), rel=1e-9)
        assert r.score_offset == pytest.approx(np.percentile(scores, 10), rel=1e-9)


def test_trees_are_isolation_trees():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5, 40, 3))
    x[:, 20:, 1] = 4.0
    settings = forest.ForestSettings(trees=5, max_features=0.7)
    heaps = forest.grow_trees(x, np.arange(5), settings)
    limit = math.ceil(math.log2(40))
    for b in range(5):
        todo, used = [(0, 0, np.arange(40))], set()
        while todo:
            node, depth, rows = todo.pop()
            assert heaps.size[b, node] == len(rows)
            f = heaps.feature[b, node]
            if f < 0:
                assert depth == limit or len(rows) == 1 or all(np.ptp(x[b, rows, k]) == 0 for k in used)
                continue
            used.add(int(f))
            values, cut = x[b, rows, f], heaps.threshold[b, node]
            assert values.min() <= cut < values.max()
            todo += [(2 * node + 1, depth + 1, rows[values <= cut]), (2 * node + 2, depth + 1, rows[values > cut])]
        assert len(used) <= 2  # int(0.7 * 3) features
    alone = forest.grow_trees(x[3:4], np.array([3]), settings)
    assert (alone.feature[0] == heaps.feature[3]).all() and (alone.threshold[0] == heaps.threshold[3]).all()


def test_bootstrap_draws_with_replacement():
    settings = forest.ForestSettings(trees=2000, max_samples=6, bootstrap=True)
    slots = forest.drawn_slots(settings, 6)
    distinct = np.mean([len(set(s)) for s in slots])
    assert distinct == pytest.approx(6 * (1 - (5 / 6) ** 6), abs=0.1)
    assert (forest.drawn_slots(forest.ForestSettings(trees=3, max_samples=4), 100) == np.arange(4)).all()


def test_fitted_forest_options(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "m", v) for i, v in enumerate(rng.normal(size=(400, 4)).tolist())] + [(999, "m", [8.0, -8.0, 8.0, 8.0])]
    df = spark.createDataFrame(rows, "id long, model string, vector array<double>")
    for more in ({"max_features": 0.5}, {"bootstrap": True, "max_samples": 64}):
        scored = forest.score_forest(df, forest.fit_forest(df, ["model"], "id", trees=30, **more), ["model"], "id")
        offset = forest.score_offset(scored, ["model"], 0.02).first()["score_offset"]
        got = {r.id: r.raw_score for r in scored.collect()}
        assert min(got, key=got.get) == 999 and offset == pytest.approx(np.percentile(list(got.values()), 2))
    with pytest.raises(ValueError):
        forest.ForestSettings(max_features=0)


def test_moments_merge_like_one_set():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3)) + 1e8
    merged = (0, np.zeros(3), np.zeros((3, 3)))
    for part in np.split(x, [7, 7, 30]):
        merged = P.merge_moments(merged, P._centred(part))
    assert merged[0] == 50 and np.allclose(merged[2] / 49, np.cov(x.T), rtol=1e-6)
    n, mean, cross = P.running_moments(P._centred(x[:20]), x[20:])
    assert n[-1] == 50 and np.allclose(cross[-1] / 49, np.cov(x.T), rtol=1e-6) and np.allclose(mean[-1], x.mean(axis=0), rtol=1e-12)


@pytest.mark.parametrize("model", ["isolation_forest", "reconstruction"])
def test_every_window_is_scored_by_its_own_past(spark, model):
    rnd = random.Random(7)
    x = [[rnd.gauss(0, 1), rnd.gauss(0, 1), 1.0] for _ in range(26)]
    x[20][1] = float("nan")
    at = F.timestamp_micros(F.col("window_index") * 1_000_000)
    windows = lambda n: frame(spark, x[:n]).withColumn("observation_timestamp", at)
    full = causal.score_causal(windows(26), COLUMNS, ("service",), model, min_history=4, trees=10)
    short = causal.score_causal(windows(18), COLUMNS, ("service",), model, min_history=4, trees=10)
    right = {(r.service, r.window_index): r for r in full.collect()}
    for r in short.collect():
        other = right[r.service, r.window_index]
        assert (r.status, r.history_windows) == (other.status, other.history_windows)
        assert r.anomaly_score == pytest.approx(other.anomaly_score) if r.anomaly_score is not None else other.anomaly_score is None
    assert right["a", 20].status == "invalid_input" and right["a", 21].history_windows == 20
    assert right["a", 0].status == "insufficient_history" and right["a", 25].status == "success"


def test_constant_history_and_empty_table(spark):
    x = [[1.0, 2.0, 3.0]] * 9 + [[1.0, 2.0, 3.5]]
    for model in ("isolation_forest", "reconstruction"):
        rows = causal.score_causal(frame(spark, x), COLUMNS, ("service",), model, min_history=3, trees=10).where("service = 'a'").orderBy("window_index").collect()
        assert [r.anomaly_score for r in rows[3:9]] == [0.0] * 6
        assert rows[9].status == "success"
        assert causal.score_causal(frame(spark, x).limit(0), COLUMNS, ("service",), model).count() == 0
    with pytest.raises(ValueError):
        P.Reconstruction(2, bottleneck=2)
    assert detectors.FOREST_TAIL["scale_factor"] == 2.0
