"""Candlestick star schema: fact plus five dimensions, and the scan that flattens it to bars.

Any DataFrame serves as a table (read.parquet, read.jdbc, a catalog table). Instrument, price type
and interval are small dimensions; timestamp and volume grow with the fact and are joined without a
hint, so that the optimiser chooses by size.

A star that is scanned often can be stored with `store_star`: its facts carry their volume, and facts and timestamps lie
in equal buckets of the timestamp, so that both growing joins are paid once and a scan shuffles nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsforge.session import scratch_path, task_count

INTERVAL_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("pub_date", T.TimestampNTZType()),
])
PRICE_TYPE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("pub_date", T.TimestampNTZType()),
])
INSTRUMENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("us_margin_requirement", T.DoubleType()),
    T.StructField("pub_date", T.TimestampNTZType()),
])
TIMESTAMP_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("pub_date", T.TimestampNTZType()),
])
VOLUME_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("volume", T.IntegerType()),
    T.StructField("pub_date", T.TimestampNTZType()),
])
CANDLESTICK_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    *(T.StructField(p, T.DoubleType()) for p in ("o", "l", "h", "c")),
    *(
        T.StructField(f"{d}_id", T.LongType())
        for d in ("volume", "timestamp", "instrument", "price_type", "interval")
    ),
    T.StructField("pub_date", T.TimestampNTZType()),
])

BAR_COLUMNS = ("instrument", "timestamp", "o", "l", "h", "c", "volume")


@dataclass(frozen=True)
class CandleStar:
    """The six tables of the star; volume is None where the candlesticks carry a volume themselves."""

    candlestick: DataFrame
    timestamp: DataFrame
    volume: DataFrame | None
    instrument: DataFrame
    price_type: DataFrame
    interval: DataFrame


def with_volume(fact: DataFrame, volume: DataFrame | None) -> DataFrame:
    if volume is None:
        return fact
    return fact.join(volume.select(F.col("id").alias("volume_id"), "volume"), "volume_id")


def store_star(star: CandleStar, buckets: int | None = None, prefix: str | None = None) -> CandleStar:
    """The star with its facts and timestamps written as bucketed tables `<prefix>_candlestick` and `<prefix>_timestamp`.

    Files go to the shared folder, one a bucket and sorted; `buckets` follows the size of the input unless given. The
    tables belong to the session's catalog until `drop_star`. Facts without a volume are not bars of any scan and are left out.
    """
    spark = star.candlestick.sparkSession
    prefix = prefix or f"star_{uuid.uuid4().hex}"
    fact = with_volume(star.candlestick, star.volume)
    buckets = buckets or task_count(fact)

    def write(table: DataFrame, key: str, name: str) -> DataFrame:
        # Rows are dealt as the buckets deal them, so that every task writes a single file.
        dealt = table.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        dealt.option("path", scratch_path(spark, name)).saveAsTable(f"{prefix}_{name}")
        return spark.table(f"{prefix}_{name}")

    return replace(
        star,
        candlestick=write(fact.drop("volume_id"), "timestamp_id", "candlestick"),
        timestamp=write(star.timestamp, "id", "timestamp"),
        volume=None,
    )


def drop_star(spark: SparkSession, prefix: str) -> None:
    """Take the stored tables out of the catalog."""
    for name in ("candlestick", "timestamp"):
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")


def sole_id(dim: DataFrame, name: str) -> Column:
    """Id of the one dimension row with this name; the query fails on none or several.

    A scalar subquery: it runs first, and its value is pushed into the scan of the fact table.
    """
    found = dim.filter(F.col("name") == name).agg(
        F.count("*").alias("n"), F.first("id").alias("id")
    )
    message = F.concat(F.lit(f"expected one row named '{name}', found "), F.col("n").cast("string"))
    return found.select(F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(message))).scalar()


def candle_scan(
    star: CandleStar, price_type_name: str, instrument_name: str, interval_name: str
) -> DataFrame:
    """Bars of one price type, instrument and interval. Order the result with orderBy if needed."""
    fact = star.candlestick.filter(
        (F.col("price_type_id") == sole_id(star.price_type, price_type_name))
        & (F.col("instrument_id") == sole_id(star.instrument, instrument_name))
        & (F.col("interval_id") == sole_id(star.interval, interval_name))
    )
    ts = star.timestamp.select(F.col("id").alias("timestamp_id"), "timestamp")
    return (
        with_volume(fact.join(ts, "timestamp_id"), star.volume)
        .withColumn("instrument", F.lit(instrument_name))
        .select(*BAR_COLUMNS)
    )


def star_join(star: CandleStar) -> DataFrame:
    """Every bar with the names of all its dimensions."""

    def named(dim: DataFrame, column: str) -> DataFrame:
        return dim.select(F.col("id").alias(f"{column}_id"), F.col("name").alias(column))

    ts = star.timestamp.select(F.col("id").alias("timestamp_id"), "timestamp")
    bars = (
        star.candlestick.join(named(star.instrument, "instrument"), "instrument_id")
        .join(named(star.price_type, "price_type"), "price_type_id")
        .join(named(star.interval, "interval"), "interval_id")
        .join(ts, "timestamp_id")
    )
    return with_volume(bars, star.volume).select("price_type", "interval", *BAR_COLUMNS)


def duplicate_bars(candlestick: DataFrame) -> DataFrame:
    """Keys that break the uniqueness of (timestamp, instrument, price type, interval)."""
    key = ["timestamp_id", "instrument_id", "price_type_id", "interval_id"]
    return candlestick.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
