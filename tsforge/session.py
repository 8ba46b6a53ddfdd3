"""Where jobs may put intermediate tables, and a session for local work."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "tsforge", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    n = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder all executors reach: the session's checkpoint folder.

    Only a local-mode session without one gets a temporary folder; a cluster has to name its own.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tsforge-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the shared one."""
    return f"{shared_root(spark)}/tsforge/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once, so that later steps neither recompute it nor lose it."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet below the shared folder and read back: unlike a checkpoint, it can be read by column."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Size of the tables that df reads, where Spark knows it; unknown sizes count as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return sum(x for x in sizes if x < 1 << 60)


def task_count(df: DataFrame, bytes_per_task: int = 64 << 20) -> int:
    """Partitions for a shuffle of df: the session's number, or more where its input asks for it."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, math.ceil(input_bytes(df) / bytes_per_task))
