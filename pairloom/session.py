"""Session settings and lineage control shared by the jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # joins of tables that are both hashed by a prefix of the keys need no new exchange
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # a persisted spectrum keeps its hashing, so descriptors read it without an exchange
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a window of samples is a wide row: keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def local_session(cpus: str | int | None = None, name: str = "pairloom") -> SparkSession:
    """Local session for tests and the bench; on a cluster the submitter configures Spark."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one of its own for a local application."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="pairloom-"))


def bounded_batches(spark: SparkSession, rows: int) -> None:
    """Arrow batches of at most ``rows`` in this session: where a row is a whole text, a batch is held several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its small partitions merged as they are written."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder.

    Used where a result is read by several later jobs.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    # writing a checkpoint runs the plan again unless its rows are held meanwhile
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint()
    finally:
        held.unpersist()
