"""Trading-day alignment of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.functions.clock import local_wall_time, shifted_date, weekday_monday0
from tsforge.functions.numeric import mean_of_present

ALIGNED_COLUMNS = (
    "instrument", "timestamp", "datetime_tz", "weekday_tz", "hour_tz", "weekday_shifted", "lhc",
    "volume",
)


def with_local_time(bars: DataFrame, tz: str) -> DataFrame:
    """Add datetime_tz (local wall time), weekday_tz (Monday 0) and hour_tz."""
    return bars.withColumn("datetime_tz", local_wall_time("timestamp", tz)).withColumns({
        "weekday_tz": weekday_monday0("datetime_tz"),
        "hour_tz": F.hour("datetime_tz"),
    })


def join_shift_lookup(annotated: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join of the trading weekday. The lookup has one row per weekday and hour, so at most
    168 rows; it is reduced to that many before the broadcast hint."""
    lookup = lookup.filter("weekday_tz between 0 and 6 and hour_tz between 0 and 23")
    one_each = lookup.groupBy("weekday_tz", "hour_tz").agg(
        F.max("weekday_shifted").alias("weekday_shifted"),
        F.count("*").alias("n"),
    )
    checked = one_each.select(
        "weekday_tz",
        "hour_tz",
        F.when(F.col("n") == 1, F.col("weekday_shifted"))
        .otherwise(F.raise_error(F.lit("shift lookup has two rows for one weekday and hour")))
        .alias("weekday_shifted"),
    )
    return annotated.join(F.broadcast(checked), ["weekday_tz", "hour_tz"], "left")


def aligned_columns(joined: DataFrame) -> DataFrame:
    """Typical price and the columns the pipeline keeps."""
    return joined.withColumn("lhc", mean_of_present("l", "h", "c")).select(*ALIGNED_COLUMNS)


def with_session_date(aligned: DataFrame, name: str = "session_date") -> DataFrame:
    """Trading day of every bar, as one expression."""
    to_shift = F.col("weekday_shifted") - F.col("weekday_tz")
    return aligned.withColumn(name, shifted_date(F.to_date("datetime_tz"), to_shift))


def session_date_by_join(aligned: DataFrame, name: str = "session_date") -> DataFrame:
    """The same day through a table of distinct shift keys, joined back with NULL equal to NULL."""
    local_date = F.to_date("datetime_tz")
    keys = aligned.select("weekday_tz", "hour_tz", "weekday_shifted", local_date.alias("local_date"))
    to_shift = F.col("weekday_shifted") - F.col("weekday_tz")
    with_shifted = keys.distinct().withColumn(name, shifted_date(F.col("local_date"), to_shift))
    left = aligned.withColumn("local_date", local_date).alias("b")
    right = with_shifted.alias("s")
    names = ("weekday_tz", "hour_tz", "weekday_shifted", "local_date")
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(f"b.{n}").eqNullSafe(F.col(f"s.{n}"))
    return left.join(right, condition, "left").select(
        *(F.col(f"b.{c}") for c in aligned.columns), F.col(f"s.{name}")
    )


def align(bars: DataFrame, lookup: DataFrame, tz: str) -> DataFrame:
    """Bars to trading-day-aligned rows; no shuffle."""
    joined = join_shift_lookup(with_local_time(bars, tz), lookup)
    return with_session_date(aligned_columns(joined))
