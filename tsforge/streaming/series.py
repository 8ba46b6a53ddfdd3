"""Stream forms of resampling and de-duplication.

Both give the same rows however the input is cut into micro-batches and in whatever order it arrives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.functions.clock import epoch_seconds, utc_wall_time
from tsforge.session import scratch_path


def instant(utc: str) -> Column:
    """TIMESTAMP of a TIMESTAMP_NTZ that holds UTC wall time; watermarks need an instant."""
    fraction = F.date_part(F.lit("SECOND"), F.col(utc)) - F.second(utc)
    return F.timestamp_micros(epoch_seconds(utc) * 1_000_000 + (fraction * 1_000_000).cast("long"))


def stream_resample(
    records: DataFrame, keys: Sequence[str], width: str, delay: str, ts: str, value: str, name: str
) -> DataFrame:
    """Tumbling mean per key for a stream without end: a window is emitted once the watermark passes
    its end, and rows that come later than that are dropped, so that state stays bounded. Empty windows
    are not emitted. For a complete result use stream_bins with merge_bins."""
    timed = records.withColumn("_at", instant(ts)).withWatermark("_at", delay)
    return (
        timed.groupBy(*keys, F.window("_at", width).alias("_w"))
        .agg(F.avg(value).alias(name))
        .select(*keys, utc_wall_time(F.unix_seconds("_w.start")).alias(ts), name)
    )


def stream_bins(records: DataFrame, keys: Sequence[str], width: str, ts: str, value: str) -> DataFrame:
    """Every record with the start of its window: what a stream lands for merge_bins. It keeps no state, so no
    record is ever late."""
    window = F.window(instant(ts), width)
    return records.select(*keys, window.alias("_w"), F.col(value).alias("_value")).select(
        *keys, utc_wall_time(F.unix_seconds("_w.start")).alias(ts), "_value"
    )


def merge_bins(landed: DataFrame, keys: Sequence[str], ts: str, name: str) -> DataFrame:
    """Mean per key and window over all that has landed so far: sums of each task first, then by key."""
    return landed.groupBy(*keys, ts).agg(F.avg("_value").alias(name))


def stream_dedupe(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct record once, however far apart its copies arrive.

    The state holds every distinct record, keyed and spread like any shuffle; choose the RocksDB state store
    for large ones. NULLs are equal to each other.
    """
    return records.dropDuplicates(list(columns))


def stream_dedupe_within(records: DataFrame, columns: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Each distinct record once, with state only for records that the watermark has not passed.

    ts (UTC wall time) is one of the columns, so copies have the same event time: a copy behind the watermark is dropped
    and never given out twice. The first copy of a record may be dropped as well, if it comes later than delay:
    with_late adds those.
    """
    if ts not in columns:
        raise ValueError("copies need the same event time: ts has to be one of the columns")
    timed = records.select(*columns).withColumn("_at", instant(ts)).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark(list(columns)).select(*columns)


def with_late(landed: DataFrame, records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What a stream has landed, and those of all records that it dropped as late, each once.

    A join of what arrived with what has landed, by the whole record; narrow it to the times that may have been late by
    filtering both.
    """
    have = landed.select(F.struct(*columns).alias("_key"))
    late = records.select(F.struct(*columns).alias("_key")).join(have, "_key", "left_anti").distinct()
    return landed.select(*columns).unionByName(late.select("_key.*"))


def run_to_end(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Process everything available now into a Parquet table below the shared folder and read it."""
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}/state")
        .option("path", f"{path}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
