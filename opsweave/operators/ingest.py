"""Record validation: parse, context headers, routing, quarantine split, store shapes.

Input rows have the shape of Spark's Kafka source with headers: key BINARY, value
BINARY, topic, partition, offset, timestamp and headers ARRAY<STRUCT<key, value>>.
Everything is a projection, so batch and streaming frames behave alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opsweave.functions.identity import EVALUATION_NAMESPACE, canonical_uuid, is_uuid, joined, uuid5
from opsweave.functions.numeric import SEVERITIES, is_finite
from opsweave.functions.steps import computed_once
from opsweave.functions.text import truncate_failure

EVENT_TYPES = ("metric", "log", "system", "anomaly", "incident", "agent")
# Default one-to-one map of event type to topic; pass your own names to the functions.
TOPICS = {
    "metric": "telemetry.metrics",
    "log": "telemetry.logs",
    "system": "system.events",
    "anomaly": "anomalies",
    "incident": "incidents",
    "agent": "agent.events",
}
CONTEXT_HEADERS = ("run_id", "scenario_id", "scenario_version", "reproducibility_key", "seed")
MAX_UINT64 = "18446744073709551615"
# Payload keys the evidence store keeps as typed columns.
EVIDENCE_FIELDS = {
    "marker": "string",
    "message": "string",
    "status_code": "int",
    "outcome": "string",
    "latency_ms": "float",
    "request_id": "string",
    "fault_id": "string",
    "fault_type": "string",
    "target_service_id": "string",
    "deployment_version": "string",
    "route": "string",
    "error": "string",
}


def _field(name: str) -> Column:
    """Text of an envelope field."""
    return F.col(f"_t.{name}")


def _kind(name: str) -> Column:
    """Type name of an envelope field; null if absent."""
    return F.col(f"_k_{name}")


def parse_events(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``event`` (struct, null when invalid) and ``event_error`` (text, null when valid).

    UTF-8 JSON with an object at the root; a missing schema_version means "1.0", any
    other declared value is refused; tenant_id (UUID), environment, service, event_type
    and severity are required.  A missing event_id is derived from the record position,
    a missing event_time is the broker time.  ``strict`` also refuses unknown keys.
    """
    names = ("schema_version", "event_id", "event_time", "tenant_id", "environment", "service", "event_type", "severity", "trace_id")
    text = F.col("value").cast("string")
    checked = computed_once(raw, F.when(F.is_valid_utf8(text), text).alias("_text"))
    # One pass for the texts, one for keys and value kinds; both keep the last of repeated keys.
    df = computed_once(
        checked,
        F.from_json("_text", ", ".join(f"{n} string" for n in names)).alias("_t"),
        F.from_json("_text", "map<string, variant>").alias("_m"),
    )
    df = computed_once(
        df,
        F.coalesce(F.map_keys("_m"), F.array().cast("array<string>")).alias("_keys"),
        *[F.schema_of_variant(F.col("_m")[n]).alias(f"_k_{n}") for n in (*names, "payload")],
    )
    position = uuid5(EVALUATION_NAMESPACE, joined("topic", "partition", "offset"))
    declared = F.array_contains("_keys", F.lit("schema_version"))
    stamp = F.try_to_timestamp(_field("event_time"))
    zoned = _field("event_time").rlike(r"(Z|z|[+-]\d{2}:?\d{2})$")

    def text_field(name: str) -> Column:
        return (_kind(name) == "STRING") & (F.length(_field(name)) > 0)

    def present(name: str) -> Column:
        return F.array_contains("_keys", F.lit(name)) & (F.coalesce(_kind(name), F.lit("VOID")) != "VOID")

    def refuse(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    known = F.array(*[F.lit(k) for k in ("schema_version", "event_id", "event_time", "tenant_id", "environment", "service",
                                         "event_type", "severity", "trace_id", "payload")])
    error = (
        F.when(F.col("_text").isNull(), "value is not valid UTF-8")
        .when(
            F.col("_m").isNull(),
            F.when(F.try_parse_json("_text").isNull(), "value is not valid JSON").otherwise("JSON root must be an object"),
        )
        .when(declared & refuse((_kind("schema_version") == "STRING") & (_field("schema_version") == "1.0")), "unsupported schema_version")
        .when(F.array_contains("_keys", F.lit("event_id")) & refuse(is_uuid(_field("event_id"))), "invalid event_id")
        .when(F.array_contains("_keys", F.lit("event_time")) & refuse(zoned & stamp.isNotNull()), "invalid event_time")
        .when(refuse((_kind("tenant_id") == "STRING") & is_uuid(_field("tenant_id"))), "invalid tenant_id")
        .when(refuse(text_field("environment")), "invalid environment")
        .when(refuse(text_field("service")), "invalid service")
        .when(refuse(_field("event_type").isin(*EVENT_TYPES)), "invalid event_type")
        .when(refuse(_field("severity").isin(*SEVERITIES)), "invalid severity")
        .when(present("trace_id") & (_kind("trace_id") != "STRING"), "invalid trace_id")
        .when(F.array_contains("_keys", F.lit("payload")) & refuse(_kind("payload").startswith("OBJECT")), "payload must be an object")
    )
    if strict:
        error = F.coalesce(error, F.when(F.size(F.array_except("_keys", known)) > 0, "unknown field"))
    event = F.struct(
        F.lit("1.0").alias("schema_version"),
        F.coalesce(canonical_uuid(_field("event_id")), position).alias("event_id"),
        F.coalesce(stamp, F.col("timestamp").cast("timestamp")).alias("event_time"),
        canonical_uuid(_field("tenant_id")).alias("tenant_id"),
        _field("environment").alias("environment"),
        _field("service").alias("service"),
        _field("event_type").alias("event_type"),
        _field("severity").alias("severity"),
        _field("trace_id").alias("trace_id"),
        F.col("_m")["payload"].alias("payload"),
    )
    graded = computed_once(df, error.alias("event_error"))
    out = computed_once(graded, F.when(F.col("event_error").isNull(), event).alias("event"))
    return out.drop(*[c for c in out.columns if c.startswith("_k_")], "_text", "_t", "_m", "_keys")


def parse_context(raw: DataFrame) -> DataFrame:
    """Adds ``ctx`` (struct), ``producer_version``, ``header_error`` and ``header_error_type``.

    The five context headers must occur exactly once, producer_version at most once (an
    empty one counts as absent).  Then every header must be UTF-8, the texts not empty,
    run_id a UUID and seed an integer in the unsigned 64-bit range.
    """
    wanted = (*CONTEXT_HEADERS, "producer_version")
    found = computed_once(raw, F.col("headers.key").alias("_names"), F.reverse("headers.key").alias("_back"))
    found = computed_once(
        found,
        *[F.coalesce(F.array_position("_names", n), F.lit(0)).alias(f"_n_{n}") for n in wanted],
        *[F.coalesce(F.array_position("_back", n), F.lit(0)).alias(f"_b_{n}") for n in wanted],
    )
    found = computed_once(
        found,
        *[F.try_element_at(F.col("headers"), F.greatest(F.col(f"_n_{n}"), F.lit(1)).cast("int"))["value"].cast("string").alias(f"_x_{n}") for n in wanted],
    )

    def absent(name: str) -> Column:
        return F.col(f"_n_{name}") == 0

    def repeated(name: str) -> Column:
        # A name seen once has the same place from both ends.
        return ~absent(name) & (F.col(f"_n_{name}") + F.col(f"_b_{name}") != F.size("_names") + 1)

    def text(name: str) -> Column:
        return F.when(~absent(name), F.col(f"_x_{name}"))

    def verdict(kind: str, message: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(message).alias("note"))

    bad = F.when(F.col("headers").isNull(), verdict("missing", "no headers"))
    for h in CONTEXT_HEADERS:
        bad = bad.when(absent(h), verdict("missing", f"header {h} is absent"))
        bad = bad.when(repeated(h), verdict("duplicate", f"header {h} occurs more than once"))
    seed = text("seed")
    digits = F.regexp_replace(F.trim(seed), "_", "")
    integer = F.trim(seed).rlike(r"^[+-]?\d+(_\d+)*$")
    number = digits.try_cast("decimal(38,0)")
    in_range = F.coalesce((number >= 0) & (number <= F.lit(MAX_UINT64).cast("decimal(38,0)")), F.lit(False))
    problems = [
        (repeated("producer_version"), "duplicate", "header producer_version occurs more than once"),
        (F.exists("headers", lambda h: ~F.is_valid_utf8(h["value"].cast("string"))), "invalid", "a header is not UTF-8"),
        *[(text(h) == "", "invalid", f"header {h} is empty") for h in ("scenario_id", "scenario_version", "reproducibility_key", "run_id")],
        (~is_uuid(text("run_id")), "invalid", "header run_id is no UUID"),
        (seed == "", "invalid", "header seed is empty"),
        (~integer, "invalid", "header seed is no integer"),
        (~in_range, "invalid", "header seed is outside the unsigned 64-bit range"),
    ]
    for cond, label, message in problems:
        bad = bad.when(cond, verdict(label, message))
    ctx = F.struct(
        canonical_uuid(text("run_id")).alias("run_id"),
        text("scenario_id").alias("scenario_id"),
        text("scenario_version").alias("scenario_version"),
        text("reproducibility_key").alias("reproducibility_key"),
        number.cast("decimal(20,0)").alias("seed"),
    )
    graded = computed_once(found, bad.alias("_bad"))
    fine = F.col("_bad").isNull()
    out = computed_once(
        graded, F.col("_bad.kind").alias("header_error_type"), F.col("_bad.note").alias("header_error"),
        F.when(fine, ctx).alias("ctx"), F.when(fine, F.nullif(text("producer_version"), F.lit(""))).alias("producer_version"),
    )
    return out.drop(*[c for c in out.columns if c.startswith(("_n_", "_b_", "_x_"))], "_names", "_back", "_bad")


def route_error(event_type: Column, topic: Column, topics: Mapping[str, str] = TOPICS, allowed: Sequence[str] | None = None) -> Column:
    """Null when the topic is the one of the event type and the type is allowed, else a message."""
    expected = F.create_map(*[F.lit(x) for pair in topics.items() for x in pair])[event_type]
    types = list(allowed) if allowed is not None else list(topics)
    return (
        F.when(topic != expected, F.concat(F.lit("Record topic '"), topic, F.lit("' does not match expected topic '"), expected, F.lit("'")))
        .when(~event_type.isin(*types), F.concat(F.lit("Event type '"), event_type, F.lit("' is not allowed")))
        .when(~topic.isin(*[topics[t] for t in types]), F.concat(F.lit("Topic '"), topic, F.lit("' is not allowed")))
    )


def validate(raw: DataFrame, topics: Mapping[str, str] = TOPICS, allowed: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """Adds ``error STRUCT<stage, type, message>``, null for a valid record.

    The first failing stage wins: deserialization, header_validation, routing_validation.
    """
    df = parse_context(parse_events(raw, strict))
    df = computed_once(df, route_error(F.col("event.event_type"), F.col("topic"), topics, allowed).alias("_route"))
    route = F.col("_route")
    header_type = F.create_map(
        F.lit("missing"), F.lit("MissingHeader"), F.lit("duplicate"), F.lit("DuplicateHeader"), F.lit("invalid"), F.lit("InvalidHeader")
    )[F.col("header_error_type")]

    def err(stage: str, kind: Column, message: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), kind.alias("type"), message.alias("message"))

    error = (
        F.when(F.col("event_error").isNotNull(), err("deserialization", F.lit("InvalidRecord"), F.col("event_error")))
        .when(F.col("header_error").isNotNull(), err("header_validation", header_type, F.col("header_error")))
        .when(route.isNotNull(), err("routing_validation", F.lit("TopicMismatch"), route))
    )
    return computed_once(df, error.alias("error")).drop("_route")


def accepted(validated: DataFrame) -> DataFrame:
    """Valid records as envelopes: event, ctx and broker position."""
    return validated.where("error IS NULL").select(
        "event", "ctx", "producer_version", "topic", "partition", "offset", "key", (F.unix_micros(F.col("timestamp").cast("timestamp")) / 1000).cast("bigint").alias("kafka_timestamp_ms")
    )


def quarantined(validated: DataFrame, consumer_group: str | None = None) -> DataFrame:
    """Refused records with the exact bytes, headers in order, and the reason."""
    headers = F.transform(
        F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")),
        lambda h: F.struct(h["key"].alias("name"), F.coalesce(F.base64(h["value"]), F.lit("")).alias("value_base64")),
    )
    return validated.where("error IS NOT NULL").select(
        uuid5(EVALUATION_NAMESPACE, joined(F.lit("quarantine"), "topic", "partition", "offset", F.col("error.stage"))).alias("quarantine_id"),
        F.lit("1.0").alias("quarantine_version"),
        F.current_timestamp().alias("quarantined_at"),
        F.col("error.stage").alias("failure_stage"),
        F.col("error.type").alias("failure_type"),
        truncate_failure(F.col("error.message")).alias("failure_message_sanitized"),
        "topic",
        "partition",
        "offset",
        F.coalesce((F.unix_micros(F.col("timestamp").cast("timestamp")) / 1000).cast("bigint"), F.lit(0)).alias("kafka_timestamp_ms"),
        F.base64("key").alias("raw_key_base64"),
        F.coalesce(F.base64("value"), F.lit("")).alias("raw_value_base64"),
        headers.alias("headers"),
        F.lit(consumer_group).cast("string").alias("consumer_group"),
        F.col("event.event_id").alias("event_id"),
        F.col("ctx.run_id").alias("run_id"),
        F.col("ctx.scenario_id").alias("scenario_id"),
        F.col("event.service").alias("service"),
        F.col("event.event_type").alias("event_type"),
    )


def split_quarantine(raw: DataFrame, topics: Mapping[str, str] = TOPICS, allowed: Sequence[str] | None = None,
                     strict: bool = False, consumer_group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) records of a batch or stream."""
    checked = validate(raw, topics, allowed, strict)
    return accepted(checked), quarantined(checked, consumer_group)


def publish(events: DataFrame, topics: Mapping[str, str] = TOPICS, producer_version: str | None = None) -> DataFrame:
    """Envelopes as records to send: topic, key, value, headers.

    The key tenant:environment:service keeps the order of a service in one partition.
    """
    topic = F.create_map(*[F.lit(x) for pair in topics.items() for x in pair])[F.col("event.event_type")]
    header = [F.struct(F.lit(h).alias("key"), F.encode(F.col(f"ctx.{h}").cast("string"), "UTF-8").alias("value")) for h in CONTEXT_HEADERS]
    if producer_version is not None:
        header.append(F.struct(F.lit("producer_version").alias("key"), F.encode(F.lit(producer_version), "UTF-8").alias("value")))
    body = F.struct(
        "event.schema_version", "event.event_id", F.date_format("event.event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("event_time"),
        "event.tenant_id", "event.environment", "event.service", "event.event_type", "event.severity", "event.trace_id", "event.payload",
    )
    return events.select(
        topic.alias("topic"),
        F.encode(F.concat_ws(":", "event.tenant_id", "event.environment", "event.service"), "UTF-8").alias("key"),
        F.encode(F.to_json(body), "UTF-8").alias("value"),
        F.array(*header).alias("headers"),
    )


def publish_summary(events: DataFrame) -> DataFrame:
    """Per run: total, metric, log, system and refused (any other type) events."""
    t = F.col("event.event_type")
    return events.groupBy(F.col("ctx.run_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(t == "metric").alias("metric_events"),
        F.count_if(t == "log").alias("log_events"),
        F.count_if(t == "system").alias("system_events"),
        F.count_if(~t.isin("metric", "log", "system")).alias("refused_events"),
    )


def _payload_field(name: str, kind: str) -> Column:
    return F.try_variant_get(F.col("event.payload"), f"$.{name}", kind)


def metric_reading() -> tuple[Column, Column]:
    """(value, error) of a metric envelope's payload; the error is null for a usable sample."""

    def kind_of(name: str) -> Column:
        return F.schema_of_variant(_payload_field(name, "variant"))

    name_ok = (kind_of("metric_name") == "STRING") & (F.trim(_payload_field("metric_name", "string")) != "")
    value_kind = kind_of("value")
    number = F.when(value_kind == "BOOLEAN", _payload_field("value", "boolean").cast("double")).when(
        value_kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _payload_field("value", "double")
    )
    error = (
        F.when(~F.coalesce(name_ok, F.lit(False)), "metric_name must be a non-empty string")
        .when(value_kind.isNull() | number.isNull(), "value must be a number or boolean")
        .when(~is_finite(number), "value must be finite")
    )
    return number, error


def refuse_unstored(validated: DataFrame, handled: Sequence[str] | None = None) -> DataFrame:
    """Sets the persistence stage on valid records that no store takes.

    These are metric events without a usable sample, and, with ``handled`` (the types that a
    handler takes), events that are neither metric, log, system nor handled.
    """
    kind = F.col("event.event_type")
    unstored = F.when(kind == "metric", metric_reading()[1])
    if handled is not None:
        unstored = unstored.when(~kind.isin("log", "system", *handled), F.concat(F.lit("no store takes event type "), kind))
    refused = F.struct(F.lit("persistence").alias("stage"), F.lit("PersistenceRejected").alias("type"), unstored.alias("message"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(unstored.isNotNull(), refused)
    return validated.withColumn("error", error)


def extract_metrics(events: DataFrame) -> DataFrame:
    """Metric samples of the envelopes: metric, value, labels, timestamp_ms and ``metric_error``.

    metric_name must be a non-blank text; value a finite number or boolean (1.0 / 0.0);
    texts are refused.  Labels are the fixed identity labels plus status_code and
    outcome when present; trace and request ids never become labels.
    """
    get = _payload_field
    number, error = metric_reading()
    labels = F.map_filter(
        F.create_map(
            F.lit("__name__"), get("metric_name", "string"),
            F.lit("service"), F.col("event.service"),
            F.lit("tenant_id"), F.col("event.tenant_id"),
            F.lit("environment"), F.col("event.environment"),
            F.lit("run_id"), F.col("ctx.run_id"),
            F.lit("scenario_id"), F.col("ctx.scenario_id"),
            F.lit("seed"), F.col("ctx.seed").cast("string"),
            F.lit("event_id"), F.col("event.event_id"),
            F.lit("status_code"), get("status_code", "string"),
            F.lit("outcome"), get("outcome", "string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return events.select(
        get("metric_name", "string").alias("metric"),
        number.alias("value"),
        labels.alias("labels"),
        F.expr("unix_micros(event.event_time) div 1000L").alias("timestamp_ms"),
        F.col("event.event_time").alias("timestamp"),
        F.col("event.event_id").alias("event_id"),
        F.col("event.service").alias("service"),
        F.col("event.tenant_id").alias("tenant_id"),
        F.col("event.environment").alias("environment"),
        F.col("ctx.run_id").alias("run_id"),
        F.col("ctx.scenario_id").alias("scenario_id"),
        F.col("ctx.seed").alias("seed"),
        get("status_code", "string").alias("status_code"),
        get("outcome", "string").alias("outcome"),
        error.alias("metric_error"),
    )


def build_evidence(events: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Evidence documents of LOG and SYSTEM envelopes, id ``run_id:event_id``.

    The known payload keys become typed columns; the whole payload stays as VARIANT.
    """
    p = F.col("event.payload")
    typed = [F.try_variant_get(p, f"$.{k}", t).alias(k) for k, t in EVIDENCE_FIELDS.items()]
    e = events.where(F.col("event.event_type").isin("log", "system"))
    return e.select(
        F.concat_ws(":", "ctx.run_id", "event.event_id").alias("document_id"),
        *[F.col(f"event.{c}").alias(c) for c in ("schema_version", "event_id", "event_time", "tenant_id", "environment", "service", "event_type", "severity", "trace_id")],
        *typed,
        p.alias("payload"),
        *[F.col(f"ctx.{c}").alias(c) for c in ("run_id", "scenario_id", "scenario_version", "reproducibility_key")],
        F.col("ctx.seed").cast("string").alias("seed"),
        (ingested_at if ingested_at is not None else F.current_timestamp()).alias("ingested_at"),
        F.col("offset"),
    )


def not_evidence(events: DataFrame) -> DataFrame:
    """Envelopes the evidence store refuses: every type but LOG and SYSTEM."""
    return events.where(~F.col("event.event_type").isin("log", "system"))


SIGNAL_ENVELOPE = ("event_time", "tenant_id", "environment", "service", "severity")
SIGNAL_CONTEXT = ("run_id", "scenario_id", "scenario_version", "reproducibility_key", "seed")
SIGNAL_SCHEMA = """signal_id string, event_time timestamp, service string, metric_or_feature string, model_name string, model_version string,
 anomaly_score double, severity string, run_id string, scenario_id string, scenario_version string, seed decimal(20,0), reproducibility_key string,
 environment string, tenant_id string, trace_id string"""


def signals_to_events(signals: DataFrame) -> DataFrame:
    """Signals as anomaly envelopes: event_id is the signal id, the payload the whole signal."""
    body = F.to_json(F.struct(*signals.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    trace = F.col("trace_id") if "trace_id" in signals.columns else F.lit(None).cast("string")
    return signals.select(
        F.struct(
            F.lit("1.0").alias("schema_version"), F.col("signal_id").alias("event_id"), "event_time", "tenant_id", "environment", "service",
            F.lit("anomaly").alias("event_type"), "severity", trace.alias("trace_id"), F.parse_json(body).alias("payload"),
        ).alias("event"),
        F.struct("run_id", "scenario_id", "scenario_version", "reproducibility_key", F.col("seed").cast("decimal(20,0)").alias("seed")).alias("ctx"),
        F.encode(F.concat_ws(":", "tenant_id", "environment", "service"), "UTF-8").alias("key"),
    )


def signals_from_events(events: DataFrame, topic: str | None = None) -> DataFrame:
    """Adds ``signal`` (null when refused) and ``handoff_error`` to anomaly envelopes.

    The route must be the anomaly route (``topic`` if given) and the payload a signal
    with a score in [0, 1]; seven envelope fields, five context fields and the key must
    repeat the payload.
    """
    parsed = F.from_json(F.to_json("event.payload"), SIGNAL_SCHEMA, {"mode": "PERMISSIVE"})
    df = computed_once(events, parsed.alias("_s"))
    route = F.col("event.event_type") == "anomaly"
    if topic is not None:
        route = route & (F.col("topic") == topic)
    score = F.col("_s.anomaly_score")
    valid = (
        F.col("_s.signal_id").isNotNull() & is_finite(score) & (score >= 0) & (score <= 1) & F.col("_s.severity").isin(*SEVERITIES)
        & F.col("_s.event_time").isNotNull() & (F.length(F.trim("_s.service")) > 0) & (F.length(F.trim("_s.model_name")) > 0)
    )
    envelope = F.col("event.event_id").eqNullSafe(F.col("_s.signal_id")) & F.col("event.trace_id").eqNullSafe(F.col("_s.trace_id"))
    for c in SIGNAL_ENVELOPE:
        envelope = envelope & F.col(f"event.{c}").eqNullSafe(F.col(f"_s.{c}"))
    context = F.lit(True)
    for c in SIGNAL_CONTEXT:
        context = context & F.col(f"ctx.{c}").eqNullSafe(F.col(f"_s.{c}"))
    key = F.col("key").eqNullSafe(F.encode(F.concat_ws(":", "_s.tenant_id", "_s.environment", "_s.service"), "UTF-8"))
    error = (
        F.when(~route, "invalid route")
        .when(~F.coalesce(valid, F.lit(False)), "invalid payload")
        .when(~envelope, "envelope does not match payload")
        .when(~context, "context does not match payload")
        .when(~key, "key does not match payload")
    )
    df = computed_once(df, error.alias("handoff_error"))
    return df.withColumn("signal", F.when(F.col("handoff_error").isNull(), F.col("_s"))).drop("_s")


OBSERVATION_DEFAULTS = {"run_id": "00000000-0000-0000-0000-000000000000", "scenario_id": "unknown", "scenario_version": "1.0.0",
                        "seed": "0", "reproducibility_key": "default"}


def observations_from_events(events: DataFrame, service: str | None = None) -> DataFrame:
    """Observations of METRIC envelopes; unusable rows are skipped, absent context gets defaults.

    A row is used when metric_name is not empty and value converts to a number.
    """
    p = F.col("event.payload")
    value = F.coalesce(F.try_variant_get(p, "$.value", "double"), F.trim(F.try_variant_get(p, "$.value", "string")).try_cast("double"),
                       F.try_variant_get(p, "$.value", "boolean").cast("double"))
    metric = F.try_variant_get(p, "$.metric_name", "string")
    rows = events.where(F.col("event.event_type") == "metric")
    if service is not None:
        rows = rows.where(F.col("event.service") == service)
    ctx = [F.coalesce(F.col(f"ctx.{c}").cast("string"), F.lit(d)).alias(c) for c, d in OBSERVATION_DEFAULTS.items()]
    return rows.select(
        *[F.col(f"event.{c}").alias(c) for c in ("event_id", "event_time", "service", "tenant_id", "environment", "trace_id")],
        metric.alias("metric_name"),
        value.alias("value"),
        *ctx,
    ).where((F.col("metric_name") != "") & is_finite(F.col("value")))


def observations_from_samples(samples: DataFrame, scenario_version: str = "1.0.0", reproducibility_key: str = "") -> DataFrame:
    """Observations of stored metric samples; without a key it is ``seed-<seed>``."""
    key = F.lit(reproducibility_key) if reproducibility_key else F.concat(F.lit("seed-"), F.col("seed").cast("string"))
    return samples.select(
        "event_id", F.col("timestamp").alias("event_time"), "service", "tenant_id", "environment", F.col("metric").alias("metric_name"), "value", "run_id",
        F.coalesce("scenario_id", F.lit("unknown")).alias("scenario_id"), F.lit(scenario_version).alias("scenario_version"), "seed", key.alias("reproducibility_key"),
    )
