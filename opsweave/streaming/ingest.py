"""Ingest stream: validate, route to the stores, quarantine the rest."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from opsweave.operators.ingest import TOPICS, accepted, build_evidence, extract_metrics, quarantined, refuse_unstored, validate
from opsweave.sources.stores import upsert_evidence, write_metric_samples


@dataclass(frozen=True)
class Sinks:
    """Where a batch goes; ``handler`` gets the accepted envelopes as a last step.

    ``handled`` names the event types beyond metric, log and system that the handler stores;
    all others are quarantined at the persistence stage.
    """

    metrics: str | None = None
    evidence: str | None = None
    quarantine: str | None = None
    handler: Callable[[DataFrame, int], None] | None = None
    handled: tuple[str, ...] = ()


def start_ingest(
    stream: DataFrame,
    sinks: Sinks,
    checkpoint: str,
    topics: Mapping[str, str] = TOPICS,
    allowed: Sequence[str] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the ingest query over a Kafka-shaped stream.

    The checkpoint takes the role of committed offsets: a batch counts only after every
    sink took it.  A repeated batch is harmless: evidence is upserted by id, metric and
    quarantine files of a batch live in a folder of their own that is overwritten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = refuse_unstored(validate(batch, topics, allowed), sinks.handled).persist()
        try:
            good = accepted(checked)
            if sinks.metrics:
                samples = extract_metrics(good.where("event.event_type = 'metric'"))
                write_metric_samples(samples, f"{sinks.metrics}/batch={batch_id}", mode="overwrite")
            if sinks.evidence:
                upsert_evidence(build_evidence(good), sinks.evidence)
            if sinks.quarantine:
                bad = quarantined(checked)
                bad.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{sinks.quarantine}/batch={batch_id}")
            if sinks.handler:
                sinks.handler(good, batch_id)
        finally:
            checked.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def metric_samples(spark, path: str) -> DataFrame:
    """Samples written by ``start_ingest``."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


__all__ = ["Sinks", "start_ingest", "metric_samples"]
