"""Pair scores on coded rows equal those on the rows as they are, and take no lookup a pair."""

import datetime as dt
import random

from pyspark.sql import functions as F

from opsweave.operators import correlate as K
from opsweave.plans.registry import round6
from test_graph_grouping import edges_df

SCHEMA = (
    "signal_id string, event_time timestamp, tenant_id long, environment string, service string, metric_or_feature string, severity string, "
    "anomaly_score double, run_id string, scenario_id string, scenario_version string, seed long, reproducibility_key string"
)


def signals(spark, n=120, seed=4):
    rnd = random.Random(seed)

    def some(*values):
        return rnd.choice([*values, *values, *values, None])

    rows = [
        (f"s{rnd.randrange(n):03d}" if rnd.random() < 0.95 else None, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randrange(600)), some(1, 2), some("prod", "dev"),
         some("gw", "ord", "pay", "db", "ghost", "twin"), some("m1", "m2"), some("info", "critical", "odd"), some(0.25, 0.75, rnd.random()),
         some("r1", "r2"), some("a", "b"), some("1", "2"), some(3, 4), some("k", "j"))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def related(spark, sig):
    nodes = spark.createDataFrame([(n, n) for n in ("gw", "ord", "pay", "db", "twin")] + [("twin-2", "twin")], "service_id string, name string")
    return K.service_relations(sig.select("service"), nodes, edges_df(spark, [("gw", "ord"), ("ord", "pay"), ("pay", "ord")]), 3)


def told(df):
    columns = [c for c in df.columns if c not in ("l", "r", "early", "late", "ahead")]
    return sorted(map(repr, df.select(*columns).collect()))


def test_coded_rows_score_alike(spark):
    sig, cfg = signals(spark), K.CorrelationConfig(threshold=0.5)
    resolution, linked = related(spark, sig)
    for match in (("tenant_id", "environment"), ("tenant_id", "environment", *K.CONTEXT)):
        # rows as they are: structs l and r only, services looked up by name
        plain = K.score_pairs(K.candidate_pairs(sig, 300, match).drop("early", "late", "ahead"), resolution, linked, cfg)
        coded = K.score_pairs(K.candidate_pairs(K.slim(sig, resolution, match), 300, match), resolution, linked, cfg)
        assert told(plain) == told(coded) and len(told(plain)) > 5
    reasons = {r.reason.split(";")[0] for r in K.score_pairs(K.candidate_pairs(K.slim(sig, resolution), 300), resolution, linked, cfg).collect()}
    assert {"topology_service_missing", "topology_service_ambiguous", "disconnected_services", "below_acceptance_threshold", "accepted"} <= reasons


def test_many_services_take_the_lookup(spark, monkeypatch):
    sig, cfg = signals(spark, 60), K.CorrelationConfig()
    resolution, linked = related(spark, sig)
    want = told(K.score_pairs(K.candidate_pairs(K.slim(sig, resolution), 300), resolution, linked, cfg))
    monkeypatch.setattr(K, "MAX_CODED_SERVICES", 2)
    assert "service_code" not in K.slim(sig, resolution).columns
    assert told(K.score_pairs(K.candidate_pairs(K.slim(sig, resolution), 300), resolution, linked, cfg)) == want


def test_a_pair_takes_no_lookup_and_few_fields(spark):
    sig, cfg = signals(spark), K.CorrelationConfig()
    resolution, linked = related(spark, sig)
    scored = K.score_pairs(K.candidate_pairs(K.slim(sig, resolution), 300), resolution, linked, cfg)

    def carried(*columns):
        """Fields of the early side of the pair join."""
        plan = scored.select("left_id", "right_id", *columns)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(plan) if "Join Inner" in line and "_b#" in line)
        assert not any("Join" in line for line in plan[:at])
        return plan[at + 1].count(" AS ")

    assert carried("temporal_score") == 3  # bucket, time, id
    assert carried("service_score") == 4 and carried("topology_score", "hops") == 4
    assert carried("reason") <= 12


def test_rounding_is_that_of_decimals(spark):
    rnd = random.Random(1)
    values = [0.0, -0.0, 0.1234565, 0.1234575, 2.5e-7, -4e-7, 5e-7, -5e-7, 1e6, 999999.9999995, -999999.9999995, 1e15, 1e300, float("inf"), float("-inf"), float("nan"), None]
    values += [rnd.uniform(-2, 2) for _ in range(2000)] + [rnd.randrange(10**7) / 1e7 for _ in range(2000)] + [rnd.uniform(-1e6, 1e6) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(round6("v").alias("a"), F.round(F.col("v") + F.lit(1e-9), 6).alias("b"))
    assert all(repr(r.a) == repr(r.b) for r in df.collect())
    assert "rint" in df._jdf.queryExecution().optimizedPlan().toString()


def test_checks_read_scores_from_a_step_of_their_own(spark, monkeypatch):
    """The scores of a pair are not copied into each check."""
    from opsweave.plans import correlation

    tables = {"signals": signals(spark), "service_edges": edges_df(spark, [("gw", "ord"), ("ord", "pay")])}
    monkeypatch.setattr(correlation, "load", lambda _spark, _folder, name: tables[name])
    plan = correlation.validate_evidence(spark, "")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    copied = [line for line in plan if "Filter" in line and "below_acceptance_threshold" in line]
    assert not copied and any("Generate inline" in line for line in plan)
