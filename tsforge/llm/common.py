"""Helpers shared by the text operators: inputs, stored intermediates, task counts, worker state."""

from __future__ import annotations

import gc
import math
import sys
import time
import types
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.session import scratch_path, stored, task_count

__all__ = [
    "discard", "ranked", "release", "scratch_path", "small_batches", "stored", "table", "task_count", "text_or_empty", "unused",
    "worker_state",
]

#: Rows in one Arrow batch on the way to Python: whole texts are wide, so the default of 10,000 is too many.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the memory of Python workers: at most `rows` rows a batch from now on in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def discard(table: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark, files = table.sparkSession, table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when their plans are collected as garbage,
    which on a driver with memory to spare may be long after a stored result has replaced them."""
    for _ in range(2):  # plans first, then what only they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def worker_state(name: str, build: Callable[[], Any], alone: bool = False) -> Any:
    """A value kept for as long as the Python worker lives; functions themselves come anew with every task.

    One that is to stand alone takes the place of all others when it is built: a worker then holds the cache of the
    operator that runs, not those of all that have run.
    """
    home = sys.modules.setdefault("_tsforge_worker", types.ModuleType("_tsforge_worker"))
    if not hasattr(home, name):
        for other in [x for x in vars(home) if alone and not x.startswith("__")]:
            delattr(home, other)
        setattr(home, name, build())
    return getattr(home, name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """The name, made longer until df has no such column, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(keys: DataFrame, order: Sequence[str], name: str, base: int = 0) -> DataFrame:
    """Distinct rows numbered base, base + 1, ... : by a hash bucket, then by `order` inside it.

    keys must be a stored table, for it is read three times. The buckets follow the row count, so that each holds
    some 65,536 rows; only the bucket counts meet in one task.
    """
    from tsforge.operators.position import global_position

    bits = min(32, max(6, math.ceil(math.log2(max(2, keys.count()))) - 16))
    bucket = F.shiftrightunsigned(F.xxhash64(*order), 64 - bits)
    placed = global_position(keys.withColumn("_b", bucket), ["_b"], list(order), name)
    return placed.withColumn(name, F.col(name) + F.lit(base)).drop("_b")
