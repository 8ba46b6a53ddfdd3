"""Train, validation and test sets stored apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(samples: DataFrame, path: str) -> None:
    """One folder per split, so that a reader of one set never scans the others."""
    samples.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored if split is None else stored.filter(F.col("split") == split)


def split_summary(samples: DataFrame) -> DataFrame:
    """Size and first position of every set."""
    return samples.groupBy("split").agg(
        F.count("*").alias("n"), F.min("position").alias("position")
    )
