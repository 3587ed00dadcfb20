"""Quarantine files: append, strict read, replay."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opsweave.operators.ingest import TOPICS

REPLAY_HEADER = "replayed"
SCHEMA = """quarantine_id string, quarantine_version string, quarantined_at timestamp, failure_stage string, failure_type string,
 failure_message_sanitized string, topic string, partition int, offset bigint, kafka_timestamp_ms bigint, raw_key_base64 string,
 raw_value_base64 string, headers array<struct<name: string, value_base64: string>>, consumer_group string, event_id string,
 run_id string, scenario_id string, service string, event_type string"""


def write_quarantine(rejected: DataFrame, path: str) -> None:
    """Append refused records as JSON lines."""
    rejected.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_quarantine(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Strict read: a malformed line fails the job."""
    df = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    return df if limit is None else df.limit(limit)


def replay(rejected: DataFrame, where: Column | None = None, limit: int | None = None, topics: Mapping[str, str] = TOPICS) -> DataFrame:
    """Records to send again: topic, raw key and value, headers plus a replay marker.

    The predicate is applied first, then the limit in (topic, partition, offset) order.
    An unknown record version, a foreign topic or absent value bytes fail the job.
    """
    rows = rejected if where is None else rejected.where(where)
    if limit is not None:
        rows = rows.orderBy("topic", "partition", "offset", "quarantine_id").limit(limit)
    ok = F.array(*[F.lit(t) for t in topics.values()])

    def guard(cond: Column, message: str, value: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))

    topic = guard(F.col("quarantine_version") == "1.0", "unsupported quarantine record version",
                  guard(F.array_contains(ok, F.col("topic")), "not a canonical topic", F.col("topic")))
    value = guard(F.col("raw_value_base64").isNotNull(), "missing raw value bytes", F.col("raw_value_base64"))
    headers = F.transform(
        F.coalesce("headers", F.array().cast("array<struct<name:string,value_base64:string>>")),
        lambda h: F.struct(h["name"].alias("key"), F.unbase64(h["value_base64"]).alias("value")),
    )
    marker = F.struct(F.lit(REPLAY_HEADER).alias("key"), F.encode(F.lit("1"), "UTF-8").alias("value"))
    return rows.select(
        "quarantine_id", topic.alias("topic"), F.unbase64("raw_key_base64").alias("key"), F.unbase64(value).alias("value"),
        F.array_append(headers, marker).alias("headers"), F.col("partition").alias("original_partition"), F.col("offset").alias("original_offset"),
    )
