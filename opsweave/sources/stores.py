"""Writers: topic records, metric samples, evidence documents, evaluation results, manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from opsweave.session import materialise, shuffle_partitions

MODEL_CSV = {
    "model_name": "model_name", "model_version": "model_version", "total_units": "total_units", "true_positives": "tp", "false_positives": "fp",
    "true_negatives": "tn", "false_negatives": "fn", "precision": "precision", "recall": "recall", "f1": "f1",
    "false_positive_rate": "false_positive_rate", "scenarios_detected": "detected_scenarios", "detection_latency_mean_sec": "mean_seconds",
    "detection_latency_median_sec": "median_seconds", "detection_latency_p95_sec": "p95_seconds", "success_units": "success_units",
    "insufficient_units": "insufficient_units", "failure_units": "failure_units",
}
SCENARIO_CSV = {
    "scenario_id": "scenario_id", "model_name": "model_name", "total_units": "total_units", "true_positives": "tp", "false_positives": "fp",
    "true_negatives": "tn", "false_negatives": "fn", "precision": "precision", "recall": "recall", "f1": "f1",
    "false_positive_rate": "false_positive_rate", "detection_status": "detection_status", "detection_latency_sec": "latency_seconds",
}
RATIOS = ("precision", "recall", "f1", "false_positive_rate")


def write_topic_files(records: DataFrame, path: str, order: Sequence[str]) -> None:
    """Records per topic; rows of one key stay in one file, sorted by ``order`` (offset or event time).

    The Kafka form of the same frame is ``records.write.format("kafka")``.
    """
    keyed = records.repartition(shuffle_partitions(records.sparkSession), "topic", "key").sortWithinPartitions("topic", "key", *order)
    keyed.write.mode("append").partitionBy("topic").parquet(path)


def write_metric_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Valid samples as parquet by metric and date.

    ``rebalance`` sizes the files at run time and splits a metric-day that holds most rows.
    """
    good = samples.where("metric_error IS NULL").drop("metric_error").withColumn("date", F.to_date("timestamp"))
    good.hint("rebalance", "metric", "date").write.mode(mode).partitionBy("metric", "date").parquet(path)


def newest_per_document(documents: DataFrame) -> DataFrame:
    """Last write per document id: latest ingested_at, then the higher offset."""
    w = Window.partitionBy("document_id").orderBy(F.col("ingested_at").desc(), F.col("offset").desc())
    return documents.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert_evidence(batch: DataFrame, path: str, buckets: int = 64) -> None:
    """Write documents by id, last write wins; repeating a batch changes nothing.

    The store is partitioned by a hash of the id, so a document stays in its bucket when its
    time changes.  ``buckets`` must stay the same for a store.  Only the batch's buckets are read
    and written, into a new version; then one small manifest, which names the version of every
    bucket, is put in place.  ``read_evidence`` goes by the last manifest: it sees all of a write
    or nothing, also when the writer dies before that.  Replaced buckets and what dead writers
    left are removed afterwards, so the folder read as plain parquet shows the same rows while
    nobody writes; a read that runs meanwhile may fail and be repeated, but never mixes versions.
    A store has one writer at a time.  VARIANT payloads are kept as JSON text.
    """
    spark = batch.sparkSession
    shaped = batch.withColumn("payload", F.to_json("payload")) if dict(batch.dtypes).get("payload") == "variant" else batch
    fresh = materialise(shaped.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")))
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    stored = stored_buckets(spark, path, fresh.schema, touched)
    merged = fresh if stored is None else fresh.unionByName(stored.select(*fresh.columns))
    number, versions = _committed(spark, path)
    version = uuid.uuid4().hex
    _write_version(newest_per_document(merged), path, version)
    _commit(spark, path, number + 1, {**versions, **{str(b): version for b in touched}})
    _remove_uncommitted(spark, path)


def _write_version(documents: DataFrame, path: str, version: str) -> None:
    versioned = documents.withColumn("version", F.concat(F.lit("v"), F.lit(version))).hint("rebalance", "bucket")
    versioned.write.mode("append").partitionBy("version", "bucket").parquet(path)


def write_uncommitted(batch: DataFrame, path: str, buckets: int = 64) -> None:
    """What a writer that dies before its manifest leaves behind; readers never see it."""
    shaped = batch.withColumn("payload", F.to_json("payload")) if dict(batch.dtypes).get("payload") == "variant" else batch
    _write_version(shaped.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")), path, uuid.uuid4().hex)


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path class for ``path``, as Spark itself would reach it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _committed(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number of the last manifest and its version of each bucket; (0, {}) before the first."""
    fs, at = _folder(spark, path)
    commits = at(f"{path}/_commits")
    if not fs.exists(commits):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(commits)]
    last = max((n for n in names if n.endswith(".json")), default=None)
    if last is None:
        return 0, {}
    stream = fs.open(at(f"{path}/_commits/{last}"))
    try:
        return int(last.removesuffix(".json")), json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, number: int, versions: dict[str, str]) -> None:
    """Put a manifest in place by one rename; a number that exists means a second writer."""
    fs, at = _folder(spark, path)
    draft, final = at(f"{path}/_commits/{uuid.uuid4().hex}.draft"), at(f"{path}/_commits/{number:012d}.json")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
    stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"another writer has committed version {number} of {path}")


def _remove_uncommitted(spark: SparkSession, path: str) -> None:
    """Remove version folders of buckets that the last manifest does not name."""
    fs, at = _folder(spark, path)
    number, versions = _committed(spark, path)
    kept = {f"version=v{v}/bucket={b}" for b, v in versions.items()}
    for status in fs.listStatus(at(path)):
        name = status.getPath().getName()
        if not name.startswith("version="):
            continue
        inside = [s.getPath().getName() for s in fs.listStatus(status.getPath())]
        stale = [x for x in inside if x.startswith("bucket=") and f"{name}/{x}" not in kept]
        if len(stale) == sum(x.startswith("bucket=") for x in inside):
            fs.delete(status.getPath(), True)
        else:
            for x in stale:
                fs.delete(at(f"{path}/{name}/{x}"), True)
    for status in fs.listStatus(at(f"{path}/_commits")):
        name = status.getPath().getName()
        if name.endswith(".draft") or int(name.removesuffix(".json")) < number:
            fs.delete(status.getPath(), False)


def _bucket_folders(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> list[str]:
    wanted = None if buckets is None else {str(b) for b in buckets}
    return [f"{path}/version=v{v}/bucket={b}" for b, v in sorted(_committed(spark, path)[1].items()) if wanted is None or b in wanted]


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """The store as its last manifest names it."""
    return spark.read.option("basePath", path).parquet(*_bucket_folders(spark, path)).drop("version")


def stored_buckets(spark: SparkSession, path: str, schema: StructType, buckets: Sequence[int]) -> DataFrame | None:
    """Stored documents of some buckets; the others' files are not read.  None before the first write."""
    folders = _bucket_folders(spark, path, buckets)
    if not folders:
        return None
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).where(F.col("bucket").isin(list(buckets)))


def _csv(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    out = []
    for name, source in columns.items():
        c = F.col(source) if source in df.columns else F.lit("1.0.0")
        text = c.cast("string")
        out.append((F.coalesce(text, F.lit("undefined")) if source in RATIOS else text).alias(name))
    return df.select(*out)


def write_evaluation(outcomes: DataFrame, scenarios: DataFrame, models: DataFrame, path: str) -> None:
    """Outcome lines sorted by (scenario, model, unit_index, event_time, id) and two summary CSVs.

    The outcomes are range-partitioned, so the files in name order are the sorted whole;
    only the summaries, one row per model and scenario, go to a single file.
    """
    order = ("scenario_id", "model_name", "unit_index", "event_time", "outcome_id")
    outcomes.orderBy(*order).write.mode("overwrite").json(f"{path}/outcomes")
    for name, df, columns in (("model_comparison", models, MODEL_CSV), ("scenario_comparison", scenarios, SCENARIO_CSV)):
        shaped = _csv(df, columns).orderBy(*[c for c in ("scenario_id", "model_name") if c in columns])
        shaped.coalesce(1).write.mode("overwrite").option("header", "true").option("emptyValue", "").option("nullValue", "").csv(f"{path}/{name}")


def artifact_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, media_type, record_count, sha256) of every data file under ``path``.

    A CSV header line is not a record.  Marker files and a manifest leave themselves out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(~F.col("path").rlike(r"/(_|\.|manifest)[^/]*$"))
    lines = F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n"))
    media = F.when(F.col("path").endswith(".csv"), "text/csv").when(F.col("path").endswith(".json"), "application/x-ndjson").otherwise("application/octet-stream")
    return files.select(
        F.substring_index("path", path.rstrip("/") + "/", -1).alias("path"),
        media.alias("media_type"),
        F.when(media == "text/csv", F.greatest(lines - 1, F.lit(0))).when(media == "application/x-ndjson", lines).alias("record_count"),
        F.sha2("content", 256).alias("sha256"),
    )
