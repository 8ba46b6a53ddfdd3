"""Scalar expressions over bar columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the daily wave has a period of 24 hours.
DAY_FREQUENCY = 2.0 * math.pi / 86_400.0


def mean_of_present(*columns: str) -> Column:
    """Row-wise mean of the columns that are neither NULL nor NaN; NULL when none is."""
    clean = [F.when(~F.isnan(c), F.col(c).cast("double")) for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in clean[1:]), F.coalesce(clean[0], F.lit(0.0)))
    count = sum((c.isNotNull().cast("int") for c in clean[1:]), clean[0].isNotNull().cast("int"))
    return F.try_divide(total, count)


def day_sine(epoch: Column | str) -> Column:
    """Sine of the UTC time of day with unit variance (amplitude 1 over a deviation of 1/sqrt 2)."""
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.sin(epoch * F.lit(DAY_FREQUENCY)) * F.lit(math.sqrt(2.0))


def day_cosine(epoch: Column | str) -> Column:
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.cos(epoch * F.lit(DAY_FREQUENCY)) * F.lit(math.sqrt(2.0))


def price_to_double(text: Column | str) -> Column:
    """Price text to double; malformed text becomes NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return text.try_cast("double")


def whole_steps(later: Column, earlier: Column, divisor: int) -> Column:
    """Number of whole steps between two instants, truncated toward zero."""
    return ((later - earlier) / F.lit(divisor)).cast("int")


def null_if_nan(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(column), column)
