"""Price records: landed response pages and the saved series file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsforge.functions.clock import utc_of_text, utc_wall_time

# The fields of a price record; all but time and price name its series.
KEY_FIELDS = ("AvailabilityZone", "InstanceType", "ProductDescription")
RECORD_FIELDS = (*KEY_FIELDS, "SpotPrice", "Timestamp")

PAGE_SCHEMA = T.StructType([
    T.StructField(
        "SpotPriceHistory",
        T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in RECORD_FIELDS])),
    ),
    T.StructField("NextToken", T.StringType()),
])

# Fixed value: the timestamp format of the saved series.
SERIES_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ssXXX"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed price pages, one JSON object per page."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def records_of_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per price record, duplicates included; columns named in keep are carried along.

    Timestamp is UTC wall time: offsets, Z and fractions in the text are resolved, and text that is no
    time is an error.
    """
    records = pages.select(*keep, F.inline("SpotPriceHistory"))
    return records.select(*keep, *KEY_FIELDS, utc_of_text("Timestamp").alias("Timestamp"), "SpotPrice")


def save_series(series: DataFrame, path: str, *keys: str) -> None:
    """Write (keys, Timestamp, spot_price) as CSV with a header; Timestamp is UTC wall time."""
    stamp = F.concat(F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    (
        series.select(*keys, stamp.alias("Timestamp"), "spot_price")
        .write.mode("errorifexists")
        .option("header", True)
        .csv(path)
    )


def read_series(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Read a saved series; offsets in the file are resolved to UTC wall time."""
    fields = [T.StructField(k, T.StringType()) for k in keys]
    fields += [
        T.StructField("Timestamp", T.StringType()),
        T.StructField("spot_price", T.DoubleType()),
    ]
    raw = spark.read.schema(T.StructType(fields)).csv(path, header=True)
    instant = F.to_timestamp("Timestamp", SERIES_TIMESTAMP_FORMAT)
    return raw.withColumn("Timestamp", utc_wall_time(F.unix_seconds(instant)))
