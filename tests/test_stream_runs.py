"""Streams against batch: gap-free grids with restarts, and late signals by policy."""

import random

import pytest
from pyspark.sql import functions as F

from opsweave.operators import correlate as K, features as W
from opsweave.plans.inputs import load
from opsweave.streaming import grid, late, windows as SW

SMALL = "/root/testdata/sf0.001"


def parts(df, column, n):
    """The rows in ``n`` parts by order of ``column``."""
    rows = df.orderBy(column).collect()
    size = -(-len(rows) // n)
    return [df.sparkSession.createDataFrame(rows[i : i + size], df.schema) for i in range(0, len(rows), size)]


@pytest.mark.parametrize("fill", ["forward_fill", "mean_fill"])
def test_stream_grid_equals_batch_grid(spark, tmp_path, fill):
    obs = load(spark, SMALL, "observations").select("event_id", "event_time", "service", "metric_name", "value")
    day = F.dayofmonth("event_time")
    holed = obs.where(~((F.col("service") == "view") & day.between(5, 9)) & ~((F.col("metric_name") == "latency_ms") & (day % 3 == 0)))
    closing = obs.limit(1).withColumn("event_time", F.lit("2030-01-01").cast("timestamp")).withColumn("event_id", F.lit(-1).cast("long"))
    cfg = W.FeatureConfig(("latency_ms:mean", "requests_total:sum"), 6 * 3600, 6 * 3600, imputation=fill, warm_up_windows=2)
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    order = ["service", "window_index", "window_start", "sample_count", "imputed_features", "missing_features", "is_warmup", "status", *cfg.columns]
    shape = lambda df: [list(r) for r in df.select(order).orderBy("service", "window_index").collect()]
    for part in [*parts(holed, "event_time", 3), closing]:  # the query stops and starts again after each part
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(obs.schema).parquet(path)
        filled = grid.grid_stream(SW.feature_windows(stream, cfg, "1 hour", ("service",), dedupe=False), cfg, ("service",))
        query = filled.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
        assert query.awaitTermination(200)
    got = spark.read.parquet(out)
    want = grid.grid_batch(SW.feature_windows(holed, cfg, "1 hour", ("service",), dedupe=False), cfg, ("service",))
    left, right = shape(got), shape(want)
    assert [r[:-2] for r in left] == [r[:-2] for r in right]
    assert [r[-2:] for r in left] == [[None if v is None else pytest.approx(v) for v in r[-2:]] for r in right]
    assert got.where("sample_count = 0").count() > 0 and got.where("status = 'imputed'").count() > 0


def test_fills_that_look_ahead_are_refused(spark):
    cfg = W.FeatureConfig(("latency_ms:mean",), 60, 60, imputation="linear_interpolate")
    with pytest.raises(ValueError):
        grid.grid_batch(spark.createDataFrame([], "service string"), cfg, ("service",))


def replay(runs, cfg):
    """The rule in plain Python: (run, id) -> disposition, taken."""
    out, taken, put_off, mark = {}, {}, [], None
    for number, run in enumerate(runs):
        rows = [(*r, False) for r in run] + [(*r, True) for r in put_off]
        put_off = []
        for i in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == i]
            prints, t, again = {r[2] for r in own}, min(r[1] for r in own), any(r[3] for r in own)
            behind = mark is not None and t < mark - cfg.allowed_lateness_seconds
            before, many = i in taken, len(own) > 1 or i in taken
            if len(prints) > 1 or before and taken[i] not in prints:
                said = "conflict"
            elif cfg.duplicate == "reject" and many:
                said = "duplicate_rejected"
            elif behind and cfg.late == "reject":
                said = "late_rejected"
            elif behind and cfg.late == "delay" and not again and not before:
                said = "late_delayed"
                put_off.append(own[0][:3])
            else:
                said = "duplicate_ignored" if many else "late_accepted" if behind else "grouped"
            use = said in ("grouped", "duplicate_ignored", "late_accepted") and not before
            if use:
                taken[i] = min(prints)
            out[number, i] = said, use
        mark = max([r[1] for r in run] + ([mark] if mark is not None else []), default=mark)
    return out


@pytest.mark.parametrize("policy,duplicate", [("accept", "ignore"), ("reject", "ignore"), ("delay", "ignore"), ("delay", "reject")])
def test_runs_follow_the_late_policy(spark, tmp_path, policy, duplicate):
    rnd = random.Random(8)
    runs = []
    for n in range(4):
        run = [(f"s{n}-{i}", 1000 * n + rnd.randint(0, 900) - rnd.choice([0, 0, 0, 700, 2000]), f"p{n}-{i}") for i in range(12)]
        if n:
            run += [runs[n - 1][0], runs[n - 1][1], (runs[n - 1][2][0], 1000 * n, "other"), run[0], (run[1][0], 5, "other")]
        runs.append(run)
    cfg = K.CorrelationConfig(late=policy, duplicate=duplicate, allowed_lateness_seconds=100)
    path, folder, checkpoint = (str(tmp_path / x) for x in ("in", "state", "ckpt"))
    schema = "signal_id string, event_time timestamp, semantic_fingerprint string"
    frames = [spark.createDataFrame(r, "signal_id string, t long, semantic_fingerprint string").select("signal_id", F.timestamp_seconds("t").alias("event_time"), "semantic_fingerprint") for r in runs]
    for frame in frames:  # a restart after each run
        frame.coalesce(1).write.mode("append").parquet(path)
        assert late.start_runs(spark.readStream.schema(schema).parquet(path), folder, checkpoint, cfg).awaitTermination(200)
    table = lambda: {(r.run, r.signal_id): (r.disposition, r.taken) for r in spark.read.parquet(f"{folder}/dispositions").collect()}
    want = replay(runs, cfg)
    assert table() == want
    late.process_run(frames[2], 2, folder, cfg)  # a run that is repeated
    assert table() == want
    assert {"accept": "late_accepted", "reject": "late_rejected", "delay": "late_delayed"}[policy] in {d for d, _ in want.values()}
    used = late.taken_signals(spark.read.parquet(path), folder)
    assert sorted(r.signal_id for r in used.collect()) == sorted({i for (_, i), (_, use) in want.items() if use})
