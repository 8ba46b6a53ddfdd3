"""Bars from raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.functions.clock import epoch_seconds

INTERVAL_SECONDS = {"Minute": 60, "Hour": 3600}


def bars_from_events(
    events: DataFrame,
    interval_name: str = "Hour",
    instrument: str = "event_type",
    ts: str = "ts",
    value: str = "value",
    tie: str = "event_id",
) -> DataFrame:
    """Open, low, high, close and count per instrument and interval.

    Partial aggregation runs before the shuffle, so a hot instrument costs one row per interval and
    map task. Ties in time are broken by the tie column.
    """
    width = INTERVAL_SECONDS[interval_name]
    epoch = epoch_seconds(ts)
    when = F.struct(F.col(ts), F.col(tie))
    return events.groupBy(
        F.col(instrument).alias("instrument"), (epoch - F.pmod(epoch, F.lit(width))).alias("timestamp")
    ).agg(
        F.min_by(value, when).alias("o"),
        F.min(value).alias("l"),
        F.max(value).alias("h"),
        F.max_by(value, when).alias("c"),
        F.count("*").cast("int").alias("volume"),
    )
