"""Session helpers. On a cluster every setting comes from the cluster's own configuration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from pathlib import PurePosixPath
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "panelcycle") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    ``spark.checkpoint.dir`` names a folder shared by driver and executors and wins
    whenever it is set. Only a local master may fall back to a temporary folder, since
    that folder would not be visible to executors on other machines.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is not None and (not configured or PurePosixPath(urlsplit(configured).path) in PurePosixPath(urlsplit(current).path).parents):
        return current
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
        configured = tempfile.mkdtemp(prefix="panelcycle-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a frame as a Parquet table under the checkpoint folder and read it back.

    Several branches of a plan can then scan it, each with its own columns and filters, instead
    of computing it again; and it survives the loss of executors.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
