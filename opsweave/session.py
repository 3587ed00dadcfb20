"""Session helpers: UTC clock, reliable checkpoints and materialised tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session clock to UTC; every entry point calls this first."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure reliable checkpoints have a home.

    The shared folder is the one the cluster names in ``spark.checkpoint.dir``.
    Only a local-mode session without that setting gets a scratch folder; on a
    cluster a machine-local folder would be lost with its executor, so we stop.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is not None:
        return
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="opsweave-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")


def materialise(df: DataFrame) -> DataFrame:
    """Run the plan once and cut its lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the one that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{what}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
