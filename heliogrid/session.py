"""Session construction and the folders shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "heliogrid") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    partitions = os.environ.get("HELIOGRID_SHUFFLE_PARTITIONS", cpus if cpus.isdigit() else "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        # small test data: keep one shuffle partition per core instead of merging to 1 MB
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("HELIOGRID_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only when the session names none and all runs on this machine (a bare local test) is one created here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="heliogrid-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder.

    Used before iterative fits: later passes read files instead of repeating the
    joins, and a lost executor costs no recomputation of the plan above.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
