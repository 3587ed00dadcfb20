"""Candidate pairs carry what is read later, on grids of bounded size."""

import datetime as dt

from pyspark.sql import functions as F

from opsweave.operators import correlate as K


def test_only_fields_that_are_read_travel(spark):
    rows = [(f"s{i}", dt.datetime(2024, 1, 1, 0, 0, i), 1, "prod", "gw", f"unread{i}") for i in range(6)]
    sig = spark.createDataFrame(rows, "signal_id string, event_time timestamp, tenant_id long, environment string, service string, note string")
    pairs = K.candidate_pairs(sig, 60).select("left_id", "right_id", F.col("l.service").alias("s"))
    joined = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == 15 and "service" in joined and not any("note" in line for line in joined.splitlines() if "LogicalRDD" not in line)


def test_grid_has_few_cells_until_cells_are_large(spark):
    def cells(n, block_rows):
        return spark.range(1).select(K.cells_a_side(F.lit(n), block_rows).alias("c")).first().c

    assert [cells(3333, 3), cells(20, 3), cells(100_000, 20_000)] == [K.MAX_CELLS, 7, 5]
    assert cells(1_024_000, 3) == 1000


def test_evidence_is_read_once_for_what_a_row_shows(spark):
    n = F.col("id").cast("string")
    evidence = spark.range(6).select(
        n.alias("left_id"), F.when(F.col("id") == 0, n).otherwise(F.concat(n, F.lit("x"))).alias("right_id"),
        F.when(F.col("id") == 1, None).otherwise(F.lit(0.1)).alias("weighted_score"), F.when(F.col("id") < 4, "accepted").otherwise("no").alias("reason"),
        (F.col("id") != 3).alias("accepted"), F.when(F.col("id") == 2, "0").otherwise("1.0.0").alias("policy_version"),
    )
    known = evidence.select(F.col("left_id").alias("signal_id")).unionByName(evidence.select(F.col("right_id").alias("signal_id")))
    known = spark.createDataFrame(known.collect(), "signal_id string")
    out = K.validate_evidence(evidence, known, K.CorrelationConfig())
    assert sorted((r.problem, r.left_id) for r in out.collect()) == [
        ("below_threshold", "0"), ("below_threshold", "2"), ("below_threshold", "4"), ("below_threshold", "5"), ("policy_mismatch", "2"), ("reason_mismatch", "3"), ("reason_mismatch", "4"), ("reason_mismatch", "5"),
        ("self_reference", "0"),
    ]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 6") == 3
