"""Queries over ingest, stores, telemetry queries and reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.functions.text import sanitise_message, secret_in_json, measured_key_in_json, truncate_failure
from opsweave.operators import ingest as S, query as Q, reliability as R
from opsweave.plans.inputs import load
from opsweave.plans.registry import query, round6
from opsweave.session import shared_folder
from opsweave.sources.quarantine import read_quarantine, replay, write_quarantine
from opsweave.sources.stores import newest_per_document, read_evidence, upsert_evidence, write_uncommitted

# Kafka-shaped records of the whole event table.  The position in a cycle of 40 decides
# which rule, if any, a record breaks; the check SQL states the expected outcome.
def raw_records(spark, folder):
    t = load(spark, folder, "telemetry")
    m = F.col("event_id") % 40
    eid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    tenant = F.concat(F.lit("00000000-0000-4000-9000-"), F.lpad(F.col("tenant_id").cast("string"), 12, "0"))
    run = F.concat(F.lit("00000000-0000-4000-a000-"), F.lpad(F.regexp_replace("run_id", "-", ""), 12, "0"))
    metric = F.col("kind") == "metric"
    number = F.when(m == 16, F.lit("true")).when(m == 17, F.lit('"NaN"')).otherwise(F.col("value").cast("string"))
    payload = F.concat(
        F.lit("{"),
        F.when(metric, F.concat(F.lit('"metric_name":"'), F.when(m == 20, F.lit(" ")).otherwise(F.col("metric_name")), F.lit('","value":'), number,
                                F.when(m % 8 == 0, F.lit(',"status_code":200,"outcome":"ok"')).otherwise(F.lit(""))))
        .when(F.col("kind") == "log", F.concat(F.lit('"message":"request '), F.col("event_id").cast("string"), F.lit('","latency_ms":'), F.col("value").cast("string")))
        .otherwise(F.concat(F.lit('"marker":"'), F.col("service"), F.lit('","fault_id":"f'), F.col("seed").cast("string"), F.lit('"'))),
        F.lit("}"),
    )
    version = F.when(m == 2, F.lit('"schema_version":"2.0",')).when(m == 3, F.lit("")).otherwise(F.lit('"schema_version":"1.0",'))
    text = F.concat(
        F.lit("{"), version, F.lit('"event_id":"'), eid, F.lit('","event_time":"'), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z","tenant_id":"'),
        F.when(m == 9, F.lit("tenant")).otherwise(tenant), F.lit('","environment":"'), F.col("environment"), F.lit('","service":"'), F.col("service"),
        F.lit('","event_type":"'), F.col("kind"), F.lit('","severity":"'), F.when(m == 10, F.lit("loud")).otherwise(F.col("severity")), F.lit('","payload":'), payload, F.lit("}"),
    )
    text = F.when(m == 1, F.substring(text, 1, 60)).when(m == 8, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    body = F.encode(text, "UTF-8")
    value = F.when(m == 7, F.concat(F.unhex(F.lit("ff")), body)).otherwise(body)

    def header(name: str, content):
        return F.struct(F.lit(name).alias("key"), content.alias("value"))

    def utf(c):
        return F.encode(c, "UTF-8")

    seed = F.when(m == 11, F.lit("12.5")).when(m == 12, F.lit("18446744073709551616")).when(m == 13, F.lit("18446744073709551615")).otherwise(F.col("seed").cast("string"))
    scenario = F.when(m == 14, F.lit("")).otherwise(F.concat(F.lit("scenario-"), (F.col("seed") % 3).cast("string")))
    base = F.array(
        header("run_id", utf(F.when(m == 18, F.lit("run")).otherwise(run))),
        header("scenario_id", F.when(m == 19, F.unhex(F.lit("fe"))).otherwise(utf(scenario))),
        header("scenario_version", utf(F.lit("1.0.0"))),
        header("reproducibility_key", utf(F.concat(F.lit("seed-"), F.col("seed").cast("string")))),
        header("seed", utf(seed)),
    )
    headers = (
        F.when(m == 4, F.slice(base, 2, 4)).when(m == 5, F.array_append(base, header("seed", utf(F.lit("1")))))
        .when(m == 15, F.array_append(base, header("producer_version", utf(F.lit(""))))).otherwise(base)
    )
    topic = F.when(m == 6, F.lit("incidents")).otherwise(
        F.when(F.col("kind") == "log", S.TOPICS["log"]).when(F.col("kind") == "system", S.TOPICS["system"]).otherwise(S.TOPICS["metric"])
    )
    return t.select(
        utf(F.concat_ws(":", tenant, "environment", "service")).alias("key"), value.alias("value"), topic.alias("topic"),
        F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("event_time").alias("timestamp"), headers.alias("headers"),
    )


RAW = """k AS (SELECT *, event_id % 40 AS m FROM telemetry),
e AS (SELECT *, CASE m WHEN 1 THEN 'value is not valid JSON' WHEN 2 THEN 'unsupported schema_version' WHEN 7 THEN 'value is not valid UTF-8'
   WHEN 8 THEN 'JSON root must be an object' WHEN 9 THEN 'invalid tenant_id' WHEN 10 THEN 'invalid severity' END AS event_error,
  CASE m WHEN 4 THEN 'missing' WHEN 5 THEN 'duplicate' WHEN 11 THEN 'invalid' WHEN 12 THEN 'invalid' WHEN 14 THEN 'invalid' WHEN 18 THEN 'invalid' WHEN 19 THEN 'invalid' END AS header_kind FROM k),
x AS (SELECT *, CASE WHEN event_error IS NOT NULL THEN 'deserialization' WHEN header_kind IS NOT NULL THEN 'header_validation' WHEN m = 6 THEN 'routing_validation' END AS stage FROM e),
good AS (SELECT * FROM x WHERE stage IS NULL)"""
EID = "'00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0')"
RUN = "'00000000-0000-4000-a000-' || lpad(replace(run_id, '-', ''), 12, '0')"
SEED = "CASE WHEN m = 13 THEN '18446744073709551615' ELSE CAST(seed AS VARCHAR) END"


def good(spark, folder):
    return S.split_quarantine(raw_records(spark, folder))[0]


def bad(spark, folder):
    return S.split_quarantine(raw_records(spark, folder), consumer_group="checks")[1]


@query("S1_parse_events", f"WITH {RAW} SELECT event_id AS offset, event_error, CASE WHEN event_error IS NULL THEN severity END AS severity FROM x", ("telemetry",))
def parse(spark, folder):
    return S.parse_events(raw_records(spark, folder)).select("offset", "event_error", F.col("event.severity").alias("severity"))


@query(
    "S2_parse_context",
    f"WITH {RAW} SELECT event_id AS offset, header_kind AS header_error_type, CASE WHEN header_kind IS NULL THEN {SEED} END AS seed FROM x",
    ("telemetry",),
)
def context(spark, folder):
    return S.parse_context(raw_records(spark, folder)).select("offset", "header_error_type", F.col("ctx.seed").cast("string").alias("seed"))


@query(
    "S3_validate_route",
    """SELECT event_id, CASE WHEN kind = 'system' THEN false WHEN kind = 'log' THEN event_id % 40 <> 6 ELSE event_id % 40 <> 6 END AS routed FROM telemetry""",
    ("telemetry",),
)
def route(spark, folder):
    t = load(spark, folder, "telemetry")
    topic = F.when(F.col("event_id") % 40 == 6, F.lit("incidents")).otherwise(
        F.create_map(*[F.lit(x) for pair in S.TOPICS.items() for x in pair])[F.col("kind")]
    )
    return t.select("event_id", S.route_error(F.col("kind"), topic, allowed=("metric", "log")).isNull().alias("routed"))


@query(
    "S4_split_quarantine",
    f"""WITH {RAW} SELECT event_id AS offset, stage AS failure_stage, CASE WHEN stage = 'deserialization' THEN event_error END AS message,
  CASE WHEN m = 4 THEN 4 WHEN m IN (5, 15) THEN 6 ELSE 5 END AS headers FROM x WHERE stage IS NOT NULL""",
    ("telemetry",),
)
def split(spark, folder):
    return bad(spark, folder).select(
        "offset", "failure_stage", F.when(F.col("failure_stage") == "deserialization", F.col("failure_message_sanitized")).alias("message"), F.size("headers").alias("headers")
    )


@query(
    "S4_all_stages",
    f"""WITH {RAW} SELECT event_id AS offset, coalesce(stage, 'persistence') AS failure_stage,
  CASE WHEN stage IS NULL THEN CASE m WHEN 17 THEN 'value must be a number or boolean' ELSE 'metric_name must be a non-empty string' END END AS persistence_message
FROM x WHERE stage IS NOT NULL OR (kind = 'metric' AND m IN (17, 20))""",
    ("telemetry",),
)
def all_stages(spark, folder):
    refused = S.quarantined(S.refuse_unstored(S.validate(raw_records(spark, folder))))
    message = F.when(F.col("failure_stage") == "persistence", F.col("failure_message_sanitized"))
    return refused.select("offset", "failure_stage", message.alias("persistence_message"))


@query("S4_accepted_records", f"WITH {RAW} SELECT {EID} AS event_id, {RUN} AS run_id, epoch_us(event_time) AS event_us, kind FROM good", ("telemetry",))
def accepted(spark, folder):
    return good(spark, folder).select(
        "event.event_id", "ctx.run_id", F.unix_micros("event.event_time").alias("event_us"), F.col("event.event_type").alias("kind")
    )


@query("S4_failure_messages", "SELECT doc_id, CASE WHEN length(trim(translate(text, chr(13) || chr(10), '  '))) > 500 THEN substr(trim(translate(text, chr(13) || chr(10), '  ')), 1, 500) || ' [truncated]' WHEN text = '' THEN 'Unknown error' ELSE trim(translate(text, chr(13) || chr(10), '  ')) END AS message FROM documents")
def messages(spark, folder):
    return load(spark, folder, "documents").select("doc_id", truncate_failure(F.col("text")).alias("message"))


@query(
    "S6_replay",
    f"""WITH {RAW} SELECT event_id AS original_offset, CASE WHEN m = 6 THEN 'incidents' WHEN kind = 'log' THEN 'telemetry.logs' WHEN kind = 'system' THEN 'system.events' ELSE 'telemetry.metrics' END AS topic,
  CASE WHEN m = 4 THEN 5 WHEN m IN (5, 15) THEN 7 ELSE 6 END AS headers, 'replayed' AS last_header FROM x WHERE stage = 'header_validation'""",
    ("telemetry",),
)
def replayed(spark, folder):
    out = replay(bad(spark, folder), F.col("failure_stage") == "header_validation")
    return out.select("original_offset", "topic", F.size("headers").alias("headers"), F.element_at("headers", -1)["key"].alias("last_header"))


@query(
    "S7_route_events",
    f"""WITH {RAW} SELECT CASE kind WHEN 'log' THEN 'telemetry.logs' WHEN 'system' THEN 'system.events' ELSE 'telemetry.metrics' END AS topic,
  '00000000-0000-4000-9000-' || lpad(CAST(tenant_id AS VARCHAR), 12, '0') || ':' || environment || ':' || service AS key, 6 AS headers, {EID} AS event_id FROM good""",
    ("telemetry",),
)
def fan_out(spark, folder):
    out = S.publish(good(spark, folder), producer_version="1.0.0")
    return out.select("topic", F.col("key").cast("string").alias("key"), F.size("headers").alias("headers"), F.get_json_object(F.col("value").cast("string"), "$.event_id").alias("event_id"))


@query(
    "S8_publish_summary",
    f"""WITH {RAW} SELECT {RUN} AS run_id, count(*) AS total_events, count(*) FILTER (WHERE kind = 'metric') AS metric_events, count(*) FILTER (WHERE kind = 'log') AS log_events,
  count(*) FILTER (WHERE kind = 'system') AS system_events, 0 AS refused_events FROM good GROUP BY run_id""",
    ("telemetry",),
)
def publish_summary(spark, folder):
    return S.publish_summary(good(spark, folder))


METRICS = """mt AS (SELECT *, CASE WHEN m = 20 THEN 'metric_name must be a non-empty string' WHEN m = 17 THEN 'value must be a number or boolean' END AS metric_error,
  CASE WHEN m = 16 THEN CAST(1 AS DOUBLE) ELSE value END AS v FROM good WHERE kind = 'metric')"""


@query(
    "S9_extract_metrics",
    f"""WITH {RAW}, {METRICS} SELECT {EID} AS event_id, metric_error, CASE WHEN m <> 20 THEN metric_name ELSE ' ' END AS metric, CASE WHEN m <> 17 THEN v END AS value,
  epoch_us(event_time) // 1000 AS timestamp_ms, CASE WHEN m % 8 = 0 THEN 10 ELSE 8 END AS labels FROM mt""",
    ("telemetry",),
)
def metrics(spark, folder):
    out = S.extract_metrics(good(spark, folder).where("event.event_type = 'metric'"))
    return out.select("event_id", "metric_error", "metric", "value", "timestamp_ms", F.size("labels").alias("labels"))


@query(
    "S10_metric_samples",
    f"WITH {RAW}, {METRICS} SELECT metric_name AS metric, CAST(CAST(event_time AS DATE) AS VARCHAR) AS date, count(*) AS samples, r6(sum(v)) AS total FROM mt WHERE metric_error IS NULL GROUP BY ALL",
    ("telemetry",),
)
def metric_samples(spark, folder):
    return samples(spark, folder).groupBy("metric", F.to_date("timestamp").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("samples"), round6(F.sum("value")).alias("total")
    )


def samples(spark, folder):
    return S.extract_metrics(good(spark, folder).where("event.event_type = 'metric'")).where("metric_error IS NULL").drop("metric_error")


EVIDENCE = f"""ev AS (SELECT *, {RUN} || ':' || {EID} AS document_id, {EID} AS eid, {RUN} AS rid, {SEED} AS sd FROM good WHERE kind IN ('log', 'system'))"""


@query(
    "S11_build_evidence",
    f"""WITH {RAW}, {EVIDENCE} SELECT document_id, kind AS event_type, severity, CASE WHEN kind = 'system' THEN service END AS marker,
  CASE WHEN kind = 'log' THEN 'request ' || CAST(event_id AS VARCHAR) END AS message, CASE WHEN kind = 'system' THEN 'f' || CAST(seed AS VARCHAR) END AS fault_id, sd AS seed FROM ev""",
    ("telemetry",),
)
def evidence(spark, folder):
    return S.build_evidence(good(spark, folder)).select("document_id", "event_type", "severity", "marker", "message", "fault_id", "seed")


@query(
    "S11_refused_evidence",
    f"WITH {RAW} SELECT kind AS event_type, count(*) AS refused FROM good WHERE kind NOT IN ('log', 'system') GROUP BY kind",
    ("telemetry",),
)
def refused(spark, folder):
    return S.not_evidence(good(spark, folder)).groupBy(F.col("event.event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("refused"))


@query(
    "S12_evidence_last_write",
    f"WITH {RAW}, {EVIDENCE} SELECT document_id, CASE WHEN kind = 'log' THEN 'second' ELSE 'first' END AS kept FROM ev",
    ("telemetry",),
)
def last_write(spark, folder):
    docs = S.build_evidence(good(spark, folder), F.lit("2024-02-01 00:00:00").cast("timestamp")).select("document_id", "event_type", "ingested_at", "offset")
    again = docs.where("event_type = 'log'").withColumn("ingested_at", F.expr("ingested_at + INTERVAL 1 HOUR"))
    both = docs.withColumn("kept", F.lit("first")).unionByName(again.withColumn("kept", F.lit("second")))
    return newest_per_document(both).select("document_id", "kept")


@query(
    "S12_upsert_across_dates",
    f"""WITH {RAW}, {EVIDENCE} SELECT document_id, kind = 'log' AS moved, epoch_us(event_time) + CASE WHEN kind = 'log' THEN 259200000000 ELSE 0 END AS us FROM ev""",
    ("telemetry",),
)
def upsert_across_dates(spark, folder):
    """Documents written twice, the second time three days later: only the later row is kept."""
    docs = S.build_evidence(good(spark, folder), F.lit("2024-02-01 00:00:00").cast("timestamp")).withColumn("moved", F.lit(False))
    later = docs.where("event_type = 'log'").withColumns({
        "event_time": F.expr("event_time + INTERVAL 3 DAYS"), "ingested_at": F.expr("ingested_at + INTERVAL 1 HOUR"), "moved": F.lit(True),
    })
    path = shared_folder(spark, "evidence")
    upsert_evidence(docs, path)
    upsert_evidence(later, path)
    return spark.read.parquet(path).select("document_id", "moved", F.unix_micros("event_time").alias("us"))


def evidence_batch(spark, folder):
    """The evidence of all good records, parsed once and kept as Parquet for the writes that repeat it."""
    docs, path = S.build_evidence(good(spark, folder), F.lit("2024-02-01 00:00:00").cast("timestamp")), shared_folder(spark, "evidence-batch")
    docs.withColumn("payload", F.to_json("payload")).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "S12_committed_version",
    f"""WITH {RAW}, {EVIDENCE} SELECT document_id, kind = 'log' AS moved, bucket_ok FROM (SELECT *, true AS bucket_ok FROM ev) e""",
    ("telemetry",),
)
def committed_version(spark, folder):
    """Two writes, one of them repeated, and a third that dies before its manifest: the second's state."""
    docs = evidence_batch(spark, folder).withColumn("moved", F.lit(False))
    later = docs.where("event_type = 'log'").withColumn("ingested_at", F.expr("ingested_at + INTERVAL 1 HOUR")).withColumn("moved", F.lit(True))
    path = shared_folder(spark, "evidence")
    upsert_evidence(docs, path)
    upsert_evidence(later, path)
    upsert_evidence(later, path)
    write_uncommitted(docs.withColumn("moved", F.lit(None).cast("boolean")), path)
    same = F.col("bucket") == F.pmod(F.xxhash64("document_id"), F.lit(64))
    return read_evidence(spark, path).select("document_id", "moved", same.alias("bucket_ok"))


@query(
    "S5_quarantine_round_trip",
    f"""WITH {RAW} SELECT event_id AS offset, stage AS failure_stage, CASE WHEN m = 4 THEN 4 WHEN m IN (5, 15) THEN 6 ELSE 5 END AS headers FROM x WHERE stage IS NOT NULL""",
    ("telemetry",),
)
def quarantine_round_trip(spark, folder):
    path = shared_folder(spark, "quarantine")
    write_quarantine(bad(spark, folder), path)
    return read_quarantine(spark, path).select("offset", "failure_stage", F.size("headers").alias("headers"))


def _signal_rows(spark, folder):
    sig = load(spark, folder, "signals")
    return sig.select(
        F.concat(F.lit("00000000-0000-4000-8000-"), "signal_id").alias("signal_id"), "event_time", "service", "metric_or_feature",
        F.lit("forecast").alias("model_name"), F.lit("1.0.0").alias("model_version"), "anomaly_score", "severity", "run_id", "scenario_id", "scenario_version",
        F.col("seed").cast("decimal(20,0)").alias("seed"), "reproducibility_key", "environment", F.col("tenant_id").cast("string").alias("tenant_id"),
        F.lit(None).cast("string").alias("trace_id"),
    )


@query(
    "S13_signals_to_events",
    """SELECT '00000000-0000-4000-8000-' || signal_id AS event_id, 'anomaly' AS event_type, severity, CAST(tenant_id AS VARCHAR) || ':' || environment || ':' || service AS key,
  r6(anomaly_score) AS payload_score FROM signals""",
    ("signals",),
)
def signal_events(spark, folder):
    out = S.signals_to_events(_signal_rows(spark, folder))
    return out.select(
        "event.event_id", "event.event_type", "event.severity", F.col("key").cast("string").alias("key"),
        round6(F.try_variant_get("event.payload", "$.anomaly_score", "double")).alias("payload_score"),
    )


@query(
    "S14_signals_from_events",
    """SELECT '00000000-0000-4000-8000-' || signal_id AS event_id, CASE service WHEN 'click' THEN 'envelope does not match payload' WHEN 'view' THEN 'context does not match payload'
  WHEN 'error' THEN 'key does not match payload' WHEN 'signup' THEN 'invalid route' END AS handoff_error,
  CASE WHEN service = 'purchase' THEN epoch_us(event_time) END AS signal_us FROM signals""",
    ("signals",),
)
def signal_handoff(spark, folder):
    out = S.signals_to_events(_signal_rows(spark, folder))
    svc = F.col("event.service")
    spoiled = (
        out.withColumn("_svc", svc)
        .withColumn("event", F.when(F.col("_svc") == "click", F.col("event").withField("severity", F.when(F.col("event.severity") == "debug", "critical").otherwise("debug")))
                    .when(F.col("_svc") == "signup", F.col("event").withField("event_type", F.lit("metric"))).otherwise(F.col("event")))
        .withColumn("ctx", F.when(F.col("_svc") == "view", F.col("ctx").withField("scenario_id", F.lit("other"))).otherwise(F.col("ctx")))
        .withColumn("key", F.when(F.col("_svc") == "error", F.encode(F.lit("x:y:z"), "UTF-8")).otherwise(F.col("key")))
    )
    return S.signals_from_events(spoiled).select("event.event_id", "handoff_error", F.unix_micros("signal.event_time").alias("signal_us"))


@query(
    "S15_observations_from_events",
    f"""WITH {RAW} SELECT {EID} AS event_id, CASE WHEN m = 20 THEN ' ' ELSE metric_name END AS metric_name, CASE WHEN m = 16 THEN CAST(1 AS DOUBLE) ELSE value END AS value,
  {RUN} AS run_id, {SEED} AS seed FROM good WHERE kind = 'metric' AND m <> 17""",
    ("telemetry",),
)
def observations(spark, folder):
    return S.observations_from_events(good(spark, folder)).select("event_id", "metric_name", "value", "run_id", "seed")


@query(
    "S15_observations_from_samples",
    f"WITH {RAW}, {METRICS} SELECT {EID} AS event_id, metric_name, v AS value, 'seed-' || {SEED} AS reproducibility_key FROM mt WHERE metric_error IS NULL",
    ("telemetry",),
)
def from_samples(spark, folder):
    return S.observations_from_samples(samples(spark, folder)).select("event_id", "metric_name", "value", "reproducibility_key")


SAMPLES = f"""{RAW}, {METRICS}, sm AS (SELECT metric_name AS metric, v AS value, epoch_us(event_time) AS us, event_time, {EID} AS event_id, service, environment, {RUN} AS run_id FROM mt WHERE metric_error IS NULL)"""


@query(
    "Q1_metric_query",
    f"""WITH {SAMPLES} SELECT event_id, us, value FROM sm WHERE metric = 'latency_ms' AND service = 'click' AND environment = 'prod'
  AND event_time >= TIMESTAMP '2024-01-05 00:00:00' AND event_time <= TIMESTAMP '2024-01-25 00:00:00'""",
    ("telemetry",),
)
def metric_query(spark, folder):
    out = Q.metric_query(samples(spark, folder), "latency_ms", "2024-01-05 00:00:00", "2024-01-25 00:00:00", service="click", environment="prod")
    return out.select("event_id", F.unix_micros("timestamp").alias("us"), "value")


@query(
    "Q2_instant_query",
    f"""WITH {SAMPLES} SELECT service, environment, arg_max(value, {{'t': us, 'e': event_id}}) AS value, max(us) AS sample_us FROM sm
WHERE metric = 'latency_ms' AND event_time <= TIMESTAMP '2024-01-15 12:00:00' AND event_time > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 12 HOUR GROUP BY ALL""",
    ("telemetry",),
)
def instant(spark, folder):
    out = Q.instant_query(samples(spark, folder), "latency_ms", "2024-01-15 12:00:00", ("service", "environment"), 12 * 3600)
    return out.select("service", "environment", "value", F.unix_micros("sample_time").alias("sample_us"))


@query(
    "Q3_range_query",
    f"""WITH {SAMPLES},
g AS (SELECT unnest(range(epoch_us(TIMESTAMP '2024-01-02 00:00:00'), epoch_us(TIMESTAMP '2024-01-29 00:00:00') + 1, 3600000000)) AS t),
s AS (SELECT DISTINCT service FROM sm WHERE metric = 'latency_ms')
SELECT s.service, g.t AS us, arg_max(sm.value, {{'t': sm.us, 'e': sm.event_id}}) AS value, max(sm.us) AS sample_us
FROM g CROSS JOIN s JOIN sm ON sm.service = s.service AND sm.metric = 'latency_ms' AND sm.us <= g.t AND sm.us > g.t - 7200000000 GROUP BY ALL""",
    ("telemetry",),
)
def range_query(spark, folder):
    out = Q.range_query(samples(spark, folder), "latency_ms", "2024-01-02 00:00:00", "2024-01-29 00:00:00", 3600, ("service",), 7200)
    return out.select("service", F.unix_micros("timestamp").alias("us"), "value", F.unix_micros("sample_time").alias("sample_us"))


@query(
    "Q4_evidence_query",
    f"""WITH {RAW}, {EVIDENCE} SELECT document_id, epoch_us(event_time) AS us, severity FROM ev
WHERE kind = 'system' AND severity = 'info' AND service = 'click' AND event_time >= TIMESTAMP '2024-01-03 00:00:00'""",
    ("telemetry",),
)
def evidence_query(spark, folder):
    docs = S.build_evidence(good(spark, folder))
    out = Q.evidence_query(docs, start="2024-01-03 00:00:00", marker="click", event_type="system", severity="info")
    return out.select("document_id", F.unix_micros("event_time").alias("us"), "severity")


@query("Q5_top_k", "SELECT event_id, value FROM telemetry ORDER BY value DESC, event_id LIMIT 100", ("telemetry",))
def top_k(spark, folder):
    return load(spark, folder, "telemetry").orderBy(F.col("value").desc(), "event_id").limit(100).select("event_id", "value")


OPS = """op AS (SELECT event_id AS seq, CASE kind WHEN 'metric' THEN 'persist' WHEN 'log' THEN 'publish' ELSE CASE severity WHEN 'debug' THEN 'quarantine' ELSE 'failure' END END AS kind,
  value AS latency_ms, seed AS retries, value * 2 + user AS e2e_ms, service, severity FROM (SELECT *, tenant_id AS user FROM telemetry) t)"""


def _operations(spark, folder):
    t = load(spark, folder, "telemetry")
    kind = F.when(F.col("kind") == "metric", "persist").when(F.col("kind") == "log", "publish").when(F.col("severity") == "debug", "quarantine").otherwise("failure")
    return t.select(
        F.col("event_id").alias("seq"), kind.alias("kind"), F.col("value").alias("latency_ms"), F.col("seed").alias("retries"),
        (F.col("value") * 2 + F.col("tenant_id")).alias("e2e_ms"), "service", "severity",
    )


@query(
    "R1_pipeline_summary",
    f"""WITH {OPS} SELECT count(*) FILTER (WHERE kind = 'publish') AS published_count, count(*) FILTER (WHERE kind = 'persist') AS persisted_count,
  count(*) FILTER (WHERE kind = 'quarantine') AS quarantined_count, count(*) FILTER (WHERE kind IN ('quarantine', 'failure')) AS failed_count,
  CAST(sum(retries) FILTER (WHERE kind = 'persist' AND retries > 0) AS BIGINT) AS retry_count,
  round(count(*) FILTER (WHERE kind IN ('persist', 'quarantine')) / 1000.0, 2) AS throughput_per_second,
  round(quantile_cont(latency_ms, 0.5) FILTER (WHERE kind = 'publish'), 3) AS publish_p50,
  round(quantile_cont(latency_ms, 0.5) FILTER (WHERE kind = 'persist'), 3) AS persistence_p50,
  round(quantile_cont(e2e_ms, 0.5) FILTER (WHERE kind = 'persist'), 3) AS e2e_p50,
  round(quantile_cont(latency_ms, 0.99) FILTER (WHERE kind = 'publish'), 3) AS publish_p99,
  round(quantile_cont(latency_ms, 0.99) FILTER (WHERE kind = 'persist'), 3) AS persistence_p99,
  round(quantile_cont(e2e_ms, 0.99) FILTER (WHERE kind = 'persist'), 3) AS e2e_p99 FROM op""",
    ("telemetry",),
)
def pipeline_summary(spark, folder):
    out = R.pipeline_summary(_operations(spark, folder), 1000.0)
    return out.select(
        "published_count", "persisted_count", "quarantined_count", "failed_count", "retry_count", "throughput_per_second",
        *[F.col(f"{s}_latency_p{p}_ms").alias(f"{s}_p{p}") for p in (50, 99) for s in ("publish", "persistence", "e2e")],
    )


@query(
    "R2_percentiles",
    f"""WITH {OPS} SELECT service, r6(coalesce(quantile_cont(latency_ms, 0.5) FILTER (WHERE kind = 'publish'), 0)) AS p50,
  r6(coalesce(quantile_cont(latency_ms, 0.99) FILTER (WHERE kind = 'publish'), 0)) AS p99, CAST(0 AS DOUBLE) AS empty FROM op GROUP BY service""",
    ("telemetry",),
)
def percentiles(spark, folder):
    shown = lambda kind: F.when(F.col("kind") == kind, F.col("latency_ms"))
    ops = _operations(spark, folder).select("service", shown("publish").alias("published"), shown("none").alias("nothing"))
    marks = R.percentiles_or_zero(ops, ["service"], "published", [50, 99])
    empty = R.percentiles_or_zero(ops, ["service"], "nothing", [50]).select("service", F.col("q")[0].alias("empty"))
    return marks.select("service", round6(F.col("q")[0]).alias("p50"), round6(F.col("q")[1]).alias("p99")).join(empty, "service")


@query(
    "R3_end_to_end_latency",
    """SELECT event_id, CASE WHEN kind <> 'system' THEN round(greatest(CAST(0 AS DOUBLE), CAST(seed * 1000 - value AS DOUBLE)), 2) END AS e2e_ms FROM telemetry""",
    ("telemetry",),
)
def end_to_end(spark, folder):
    broker = F.when(F.col("kind") == "system", F.lit(0.0)).otherwise(F.lit(1.7e12))
    now = F.lit(1.7e12) + (F.col("seed") * 1000 - F.col("value"))
    return load(spark, folder, "telemetry").select("event_id", F.round(R.end_to_end_ms(now, broker), 2).alias("e2e_ms"))


@query(
    "R4_consumer_lag",
    """WITH ends AS (SELECT service AS topic, tenant_id AS partition, max(event_id) AS end_offset FROM telemetry GROUP BY ALL),
c AS (SELECT service AS topic, tenant_id AS partition, max(event_id) AS committed_offset FROM telemetry WHERE kind = 'metric' AND severity = 'critical' GROUP BY ALL)
SELECT topic, partition, greatest(0, end_offset - coalesce(committed_offset, 0)) AS lag FROM ends LEFT JOIN c USING (topic, partition)""",
    ("telemetry",),
)
def lag(spark, folder):
    t = load(spark, folder, "telemetry").withColumnRenamed("service", "topic").withColumnRenamed("tenant_id", "partition")
    ends = t.groupBy("topic", "partition").agg(F.max("event_id").alias("end_offset"))
    done = t.where("kind = 'metric' AND severity = 'critical'").groupBy("topic", "partition").agg(F.max("event_id").alias("committed_offset"))
    return R.consumer_lag(ends, done)


@query(
    "R5_reconcile",
    """SELECT event_id, 'missing' AS problem FROM telemetry WHERE kind <> 'metric' AND severity = 'debug'
UNION ALL SELECT event_id, 'unexpected' FROM telemetry WHERE kind = 'metric' AND severity <> 'debug'""",
    ("telemetry",),
)
def reconcile(spark, folder):
    t = load(spark, folder, "telemetry")
    return R.reconcile(t.where("severity = 'debug'"), t.where("kind = 'metric'"), "event_id")


@query(
    "R6_operation_rollup",
    f"""WITH {OPS} SELECT kind, service, severity, count(*) AS operations, r6(avg(latency_ms)) AS mean_ms, r6(max(latency_ms)) AS max_ms,
  r6(quantile_cont(latency_ms, 0.5)) AS p50_ms, r6(quantile_cont(latency_ms, 0.95)) AS p95_ms FROM op GROUP BY ALL""",
    ("telemetry",),
)
def rollup(spark, folder):
    out = R.rollup(_operations(spark, folder), ["kind", "service", "severity"])
    return out.select("kind", "service", "severity", "operations", *[round6(c).alias(c) for c in ("mean_ms", "max_ms", "p50_ms", "p95_ms")])


_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(
    "R7_sanitise_messages",
    rf"""WITH t AS (SELECT doc_id, {_CLEAN} AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' THEN '' WHEN regexp_matches(s, '(?i)\btraceback\b') OR regexp_matches(s, '(?i)\b(?:password|secret|token|api[_-]?key|credential)s?\b')
  OR regexp_matches(s, '\b[A-Za-z]:[\\/][^\s]*') OR regexp_matches(s, '\\\\[^\\/\s]+[\\/][^\s]+') OR regexp_matches(s, '(^|[^\w:])/(?:[^/\s]+/)*[^/\s]+')
  OR regexp_matches(s, '(?i)<[^>]*(?:object|instance)[^>]*>') OR regexp_matches(s, '\b0x[0-9A-Fa-f]+\b') OR regexp_matches(s, '^[\[{{].*[\]}}]$') THEN 'Operation failed'
  WHEN length(s) > 500 THEN substr(s, 1, 497) || '...' ELSE s END AS message FROM t""",
)
def sanitise(spark, folder):
    return load(spark, folder, "documents").select("doc_id", sanitise_message(F.col("text")).alias("message"))


@query(
    "R8_config_scan",
    """SELECT conv_id, turn, regexp_matches(lower(text), 'password|secret|api_key|apikey|access_token|bearer |private_key|client_secret') AS has_secret,
  role = 'user' AS has_measured_key FROM conversations""",
)
def config_scan(spark, folder):
    c = load(spark, folder, "conversations")
    doc = F.to_json(F.struct(F.struct(F.col("text").alias("note"), F.when(F.col("role") == "user", F.lit(1)).alias("F1_Score_Value_x")).alias("config")))
    return c.select("conv_id", "turn", secret_in_json(doc).alias("has_secret"), measured_key_in_json(doc).alias("has_measured_key"))
