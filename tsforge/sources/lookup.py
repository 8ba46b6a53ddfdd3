"""Weekday shift lookup: (weekday_tz, hour_tz) to the trading weekday."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SHIFT_LOOKUP_SCHEMA = T.StructType([
    T.StructField("weekday_tz", T.IntegerType()),
    T.StructField("hour_tz", T.IntegerType()),
    T.StructField("weekday_shifted", T.IntegerType()),
])


def shift_lookup_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHIFT_LOOKUP_SCHEMA).csv(path, header=True)
