import hashlib
import json

import pytest
from pyspark.sql import functions as F

from opsweave.operators import correlate as K
from opsweave.operators import evaluation as E
from opsweave.operators import features as W
from opsweave.operators import ingest as S
from opsweave.plans import ingest as P
from opsweave.plans.evaluation import _outcomes
from opsweave.plans.inputs import load
from opsweave.sources import quarantine as QF
from opsweave.sources import stores
from opsweave.streaming import ingest as SI
from opsweave.streaming import windows as SW

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "records")
    P.raw_records(spark, SMALL).repartition(4).write.parquet(path)
    return path


def event(**over):
    body = dict(tenant_id="00000000-0000-4000-9000-000000000001", environment="e", service="s", event_type="metric", severity="info", payload={"metric_name": "m", "value": 1})
    body.update(over)
    return json.dumps({k: v for k, v in body.items() if v is not ...})


@pytest.mark.parametrize(
    "text,error",
    [
        (event(), None),
        (event(schema_version=1.0), "unsupported schema_version"),
        (event(schema_version=None), "unsupported schema_version"),
        (event(environment=""), "invalid environment"),
        (event(service=5), "invalid service"),
        (event(tenant_id=...), "invalid tenant_id"),
        (event(event_time="2024-01-01T00:00:00"), "invalid event_time"),
        (event(event_time="2024-01-01T00:00:00+02:00"), None),
        (event(payload=[1]), "payload must be an object"),
        (event(trace_id=None), None),
        (event(trace_id=7), "invalid trace_id"),
        ("[]", "JSON root must be an object"),
        ("3", "JSON root must be an object"),
        ("{", "value is not valid JSON"),
    ],
)
def test_record_rules(spark, text, error):
    df = spark.createDataFrame([(bytearray(text, "utf-8"), "t", 0, 1)], "value binary, topic string, partition int, offset long")
    out = S.parse_events(df.withColumn("timestamp", F.timestamp_seconds(F.lit(5)))).first()
    assert out.event_error == error and (out.event is None) == (error is not None)


@pytest.mark.parametrize(
    "value,error,number",
    [("2.5", None, 2.5), ("true", None, 1.0), ("false", None, 0.0), ('"3"', "value must be a number or boolean", None), ("null", "value must be a number or boolean", None)],
)
def test_metric_values(spark, value, error, number):
    text = event().replace('"value": 1', f'"value": {value}')
    df = spark.createDataFrame([(bytearray(text, "utf-8"), "telemetry.metrics", 0, 1)], "value binary, topic string, partition int, offset long")
    events = S.parse_events(df.withColumn("timestamp", F.timestamp_seconds(F.lit(5))))
    ctx = F.struct(*[F.lit("x").alias(c) for c in S.CONTEXT_HEADERS])
    row = S.extract_metrics(events.withColumn("ctx", ctx)).first()
    assert (row.metric_error, row.value) == (error, number) and "trace_id" not in row.labels


def test_quarantine_round_trip_and_replay(spark, raw, tmp_path):
    path = str(tmp_path / "q")
    bad = S.split_quarantine(spark.read.parquet(raw))[1]
    QF.write_quarantine(bad, path)
    stored = QF.read_quarantine(spark, path)
    assert stored.count() == bad.count()
    source = {r.offset: r for r in spark.read.parquet(raw).collect()}
    out = QF.replay(stored, F.col("failure_stage") == "deserialization", limit=7).collect()
    assert len(out) == 7
    for r in out:
        before = source[r.original_offset]
        assert (r.key, r.value) == (before.key, before.value)
        assert [tuple(h) for h in r.headers[:-1]] == [tuple(h) for h in before.headers] and r.headers[-1].key == QF.REPLAY_HEADER
    with pytest.raises(Exception, match="version"):
        QF.replay(stored.withColumn("quarantine_version", F.lit("9"))).collect()
    spark.createDataFrame([('{"topic": 1, broken',)], "value string").write.mode("append").text(path)
    with pytest.raises(Exception):
        QF.read_quarantine(spark, path).collect()


def test_evidence_upsert_is_idempotent(spark, raw, tmp_path):
    path = str(tmp_path / "evidence")
    docs = S.build_evidence(S.split_quarantine(spark.read.parquet(raw))[0], F.timestamp_seconds(F.lit(10)))
    stores.upsert_evidence(docs, path)
    stores.upsert_evidence(docs, path)
    newer = docs.where("event_type = 'log'").withColumn("severity", F.lit("changed")).withColumn("ingested_at", F.timestamp_seconds(F.lit(20)))
    stores.upsert_evidence(newer, path)
    out = spark.read.parquet(path)
    assert out.count() == docs.count() == out.select("document_id").distinct().count()
    assert out.where("event_type = 'log' and severity <> 'changed'").count() == 0
    moved = docs.withColumn("event_time", F.expr("event_time + INTERVAL 9 DAYS")).withColumn("ingested_at", F.timestamp_seconds(F.lit(30)))
    stores.upsert_evidence(moved, path)
    assert spark.read.parquet(path).count() == docs.count()
    one = stores.stored_buckets(spark, path, spark.read.parquet(path).schema, [3])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_result_files_and_manifest(spark, tmp_path):
    path = str(tmp_path / "results")
    outcomes = _outcomes(spark, SMALL)
    scenarios = E.by_scenario(outcomes)
    stores.write_evaluation(outcomes, scenarios, E.by_model(scenarios).join(E.latency_summary(scenarios), "model_name"), path)
    lines = [json.loads(x) for f in sorted((tmp_path / "results" / "outcomes").glob("part-*")) for x in f.read_text().splitlines()]
    keys = [(x["scenario_id"], x["model_name"], x["unit_index"]) for x in lines]
    assert keys == sorted(keys) and len(keys) == outcomes.count()
    (model_csv,) = (tmp_path / "results" / "model_comparison").glob("part-*.csv")
    (scenario_csv,) = (tmp_path / "results" / "scenario_comparison").glob("part-*.csv")
    assert len(model_csv.read_text().splitlines()[0].split(",")) == 18 and len(scenario_csv.read_text().splitlines()[0].split(",")) == 13
    entries = {r.path: r for r in stores.artifact_manifest(spark, path).collect()}
    for rel, r in entries.items():
        assert r.sha256 == hashlib.sha256((tmp_path / "results" / rel).read_bytes()).hexdigest()
    assert sum(r.record_count for r in entries.values() if r.media_type == "application/x-ndjson") == len(lines)
    assert entries[f"model_comparison/{model_csv.name}"].record_count == 2


def test_topic_files_keep_keys_together(spark, raw, tmp_path):
    records = S.publish(S.split_quarantine(spark.read.parquet(raw))[0])
    id_of = F.get_json_object(F.col("value").cast("string"), "$.event_time")
    stores.write_topic_files(records.withColumn("at", id_of), str(tmp_path / "topics"), ["at"])
    back = spark.read.parquet(str(tmp_path / "topics"))
    for file in {r[0] for r in back.select(F.input_file_name()).distinct().collect()}:
        rows = [(r.key, r["at"]) for r in spark.read.parquet(file).coalesce(1).collect()]
        assert rows == sorted(rows)
    assert back.count() == records.count()
    spread = back.select("topic", "key", F.input_file_name().alias("f")).groupBy("topic", "key").agg(F.countDistinct("f").alias("files"))
    assert spread.agg(F.max("files")).first()[0] == 1


def test_ingest_stream_equals_batch(spark, raw, tmp_path):
    source = spark.read.parquet(raw)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(raw)
    seen = []
    sinks = SI.Sinks(str(tmp_path / "m"), str(tmp_path / "e"), str(tmp_path / "q"), lambda good, i: seen.append((i, good.count())))
    query = SI.start_ingest(stream, sinks, str(tmp_path / "ckpt"))
    assert query.awaitTermination(100)
    good, bad = S.split_quarantine(source)
    samples = S.extract_metrics(good.where("event.event_type = 'metric'")).where("metric_error IS NULL")
    ids = lambda df, c: sorted(r[0] for r in df.select(c).collect())
    assert len(seen) > 1 and sum(n for _, n in seen) == samples.count() + S.build_evidence(good).count()
    assert ids(SI.metric_samples(spark, str(tmp_path / "m")), "event_id") == ids(samples, "event_id")
    assert ids(spark.read.parquet(str(tmp_path / "e")), "document_id") == ids(S.build_evidence(good), "document_id")
    refused = S.quarantined(S.refuse_unstored(S.validate(source), ()))
    assert ids(spark.read.schema(QF.SCHEMA).json(str(tmp_path / "q" / "*")), "quarantine_id") == ids(refused, "quarantine_id")
    # every record is in exactly one store
    assert source.count() == samples.count() + S.build_evidence(good).count() + refused.count() and refused.count() > bad.count()


def _stream(spark, df, path, files=3):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(100)
    return df.sparkSession.table(name)


def test_streaming_windows_equal_batch_windows(spark, tmp_path):
    obs = load(spark, SMALL, "observations").select("event_id", "event_time", "service", "metric_name", "value")
    closing = obs.limit(1).withColumn("event_time", F.lit("2030-01-01").cast("timestamp")).withColumn("event_id", F.lit(-1).cast("long"))
    cfg = W.FeatureConfig(("latency_ms:mean", "latency_ms:p95", "requests_total:sum"), 6 * 3600, 3 * 3600)
    batch = SW.feature_windows(obs, cfg, "40 days", ("service",), dedupe=False)
    stream = _stream(spark, obs.unionByName(obs).unionByName(closing), str(tmp_path / "obs"))
    got = _drain(SW.feature_windows(stream, cfg, "40 days", ("service",)), "feature_windows_stream")
    shape = lambda df: sorted((r[0], r[1], r[2], *[None if v is None else round(v, 6) for v in r[3:]]) for r in df.drop("window_end").collect())
    assert shape(got.where("window_start < '2029-01-01'")) == shape(batch)


def test_streaming_intake_reports_duplicates_and_conflicts(spark, tmp_path):
    rows = [("a", "x"), ("a", "x"), ("b", "y"), ("b", "z"), ("c", "w")]
    df = spark.createDataFrame(rows, "signal_id string, semantic_fingerprint string")
    got = _drain(SW.intake(_stream(spark, df, str(tmp_path / "sig")), ttl_ms=None), "intake_stream")
    out = sorted((r.signal_id, r.disposition) for r in got.collect())
    assert out == [("a", "accepted"), ("a", "duplicate"), ("b", "accepted"), ("b", "conflict"), ("c", "accepted")]


def test_late_split_follows_the_policy(spark):
    df = spark.createDataFrame([(69,), (70,)], "t long").withColumn("event_time", F.timestamp_seconds("t"))
    for late, sizes in (("accept", (2, 0)), ("delay", (1, 1)), ("reject", (1, 1))):
        on_time, behind = SW.split_late(df, "1970-01-01 00:01:40", K.CorrelationConfig(late=late))
        assert (on_time.count(), behind.count()) == sizes


def test_streaming_sessions(spark, tmp_path):
    rows = [("k", 0, "info"), ("k", 50, "error"), ("k", 500, "debug"), ("k", 100_000, "info")]
    df = spark.createDataFrame(rows, "key string, t long, severity string").withColumn("event_time", F.timestamp_seconds("t")).drop("t")
    got = _drain(SW.signal_sessions(_stream(spark, df, str(tmp_path / "s"), files=1), ["key"], 100, "1000 seconds"), "session_stream")
    assert sorted((r.signals, r.severity) for r in got.collect()) == [(1, "debug"), (2, "error")]
