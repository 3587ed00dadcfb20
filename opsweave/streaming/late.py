"""Signal intake in runs, with late signals accepted, rejected or read again by the next run.

Each micro-batch is a run.  What a run needs of earlier ones lies in tables partitioned by
run under one folder, and a run only ever replaces its own partitions, so a run that is
repeated after a failure gives what it gave before:

* ``marks``: the latest event time seen up to a run; run n is judged by the marks before it;
* ``dispositions``: one row per id and run, and whether the signal was taken;
* ``delayed``: rows that a run put off; the next run reads them with its own and takes them.

All of it is joins and aggregates; nothing is called per id in Python.

Defined cases: before the first mark nothing is late; an id that was taken before is a
duplicate, or a conflict if its fingerprint differs, and is not taken again; an id with two
fingerprints in one run is a conflict and not taken; an id put off and sent again in the next
run counts once, as a duplicate.  ``remember_seconds`` bounds how far behind the mark earlier
ids are looked up (None: all).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from opsweave.operators.correlate import CorrelationConfig

MARKS = "run long, latest_us long"
DISPOSITIONS = "signal_id string, semantic_fingerprint string, event_time timestamp, duplicate_count long, late boolean, put_off boolean, disposition string, taken boolean, run long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _replace(df: DataFrame, path: str, run: int) -> None:
    df.withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def judge_run(signals: DataFrame, marks: DataFrame, taken: DataFrame, delayed: DataFrame, cfg: CorrelationConfig, remember_seconds: int | None = None) -> DataFrame:
    """Dispositions of a run's own and put-off signals (signal_id, event_time, semantic_fingerprint).

    ``marks`` (latest_us) and ``taken`` (signal_id, semantic_fingerprint, event_time) are of
    earlier runs.  Rules in order: conflict, rejected duplicate, late by policy, duplicate,
    late but taken, grouped.
    """
    columns = ["signal_id", "semantic_fingerprint", "event_time"]
    rows = signals.select(*columns, F.lit(False).alias("_again")).unionByName(delayed.select(*columns, F.lit(True).alias("_again")))
    mark = marks.agg(F.max("latest_us").alias("_mark"))  # one row
    earlier = taken.select("signal_id", F.col("semantic_fingerprint").alias("_before"), F.unix_micros("event_time").alias("_us"))
    if remember_seconds is not None:
        known = earlier.join(F.broadcast(mark)).where(F.col("_us") >= F.col("_mark") - remember_seconds * 1_000_000)
        earlier = known.drop("_mark")
    ids = rows.groupBy("signal_id").agg(
        F.min("semantic_fingerprint").alias("semantic_fingerprint"), F.max("semantic_fingerprint").alias("_other"), F.min("event_time").alias("event_time"),
        F.count(F.lit(1)).alias("duplicate_count"), F.max("_again").alias("put_off"),
    )
    met = ids.join(earlier.select("signal_id", "_before"), "signal_id", "left").join(F.broadcast(mark))
    late = F.coalesce(F.unix_micros("event_time") < F.col("_mark") - cfg.allowed_lateness_seconds * 1_000_000, F.lit(False))
    again = F.col("_before").isNotNull()
    conflict = (F.col("semantic_fingerprint") != F.col("_other")) | (again & (F.col("_before") != F.col("semantic_fingerprint")))
    duplicate = (F.col("duplicate_count") > 1) | again
    out = F.when(conflict, "conflict")
    if cfg.duplicate == "reject":
        out = out.when(duplicate, "duplicate_rejected")
    if cfg.late == "reject":
        out = out.when(F.col("late"), "late_rejected")
    elif cfg.late == "delay":
        out = out.when(F.col("late") & ~F.col("put_off") & ~again, "late_delayed")
    out = out.when(duplicate, "duplicate_ignored").when(F.col("late"), "late_accepted").otherwise("grouped")
    judged = met.withColumn("late", late).withColumn("disposition", out)
    used = F.col("disposition").isin("grouped", "duplicate_ignored", "late_accepted") & ~again
    return judged.withColumn("taken", used).select("signal_id", "semantic_fingerprint", "event_time", "duplicate_count", "late", "put_off", "disposition", "taken")


def process_run(signals: DataFrame, run: int, folder: str, cfg: CorrelationConfig, remember_seconds: int | None = None) -> None:
    """Judge one micro-batch and write its partitions of all tables; repeating it changes nothing."""
    spark = signals.sparkSession
    own = signals.persist()
    marks = _read(spark, f"{folder}/marks", MARKS).where(F.col("run") < run)
    earlier = _read(spark, f"{folder}/dispositions", DISPOSITIONS).where((F.col("run") < run) & F.col("taken"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema.fields)
    delayed = _read(spark, f"{folder}/delayed", f"{fields}, run long").where(F.col("run") == run - 1).drop("run")
    judged = judge_run(own, marks, earlier, delayed, cfg, remember_seconds).persist()
    _replace(judged, f"{folder}/dispositions", run)
    off = judged.where("disposition = 'late_delayed'").select("signal_id")
    _replace(own.join(off, "signal_id", "left_semi").dropDuplicates(["signal_id"]), f"{folder}/delayed", run)
    latest = own.agg(F.max(F.unix_micros("event_time")).alias("latest_us")).unionByName(marks.agg(F.max("latest_us").alias("latest_us")))
    _replace(latest.agg(F.max("latest_us").alias("latest_us")), f"{folder}/marks", run)
    judged.unpersist()
    own.unpersist()


def taken_signals(signals: DataFrame, folder: str) -> DataFrame:
    """Rows of a signal table that some run has taken, one per id."""
    ids = _read(signals.sparkSession, f"{folder}/dispositions", DISPOSITIONS).where("taken").select("signal_id", "semantic_fingerprint", F.col("run").alias("taken_in_run"))
    return signals.join(ids, ["signal_id", "semantic_fingerprint"]).dropDuplicates(["signal_id"])


def start_runs(stream: DataFrame, folder: str, checkpoint: str, cfg: CorrelationConfig, remember_seconds: int | None = None, **trigger) -> StreamingQuery:
    """Runs over a stream of signals; ``trigger`` as in ``DataStreamWriter.trigger``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, run: process_run(batch, run, folder, cfg, remember_seconds)).start()
