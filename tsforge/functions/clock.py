"""Calendar expressions. None depends on the session time zone; instants are epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


def epoch_seconds(utc: Column | str) -> Column:
    """Epoch seconds of a TIMESTAMP_NTZ that holds UTC wall time."""
    utc = F.col(utc) if isinstance(utc, str) else utc
    days = F.datediff(utc.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * SECONDS_PER_DAY + F.hour(utc) * 3600 + F.minute(utc) * 60 + F.second(utc)


def utc_wall_time(epoch: Column | str) -> Column:
    """TIMESTAMP_NTZ with the UTC wall time of an epoch second."""
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.lit(0)
    days = F.floor(epoch / SECONDS_PER_DAY).cast("int")
    return origin + F.make_dt_interval(days, zero, zero, F.pmod(epoch, F.lit(SECONDS_PER_DAY)))


def utc_of_text(text: Column | str) -> Column:
    """TIMESTAMP_NTZ with the UTC wall time of an ISO time; without an offset the text is UTC already.

    Fractions of a second are kept. Text that is no time is an error, NULL stays NULL.
    """
    text = F.col(text) if isinstance(text, str) else text
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    micros = F.unix_micros(F.try_to_timestamp(zoned))
    zero = F.lit(0)
    fraction = F.make_dt_interval(zero, zero, zero, (F.pmod(micros, F.lit(1_000_000)) / 1e6).cast("decimal(18,6)"))
    found = utc_wall_time(F.floor(micros / F.lit(1_000_000)).cast("long")) + fraction
    wrong = F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp_ntz")
    return F.when(text.isNotNull() & micros.isNull(), wrong).otherwise(found)


def local_wall_time(epoch: Column | str, tz: str) -> Column:
    """TIMESTAMP_NTZ with the wall time in tz; two instants share an hour when clocks fall back."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall_time(epoch))


def weekday_monday0(ts: Column | str) -> Column:
    return F.weekday(ts)


def shifted_date(date: Column, to_shift: Column) -> Column:
    """Trading day: forward by a positive shift, one day for Sunday to Monday (-6), else unchanged."""
    return (
        F.when(to_shift > 0, F.date_add(date, to_shift.cast("int")))
        .when(to_shift == -6, F.date_add(date, 1))
        .otherwise(date)
    )
