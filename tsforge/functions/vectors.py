"""Expressions over array<double> columns of bounded length (a window or a day)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plug-in feature maps a look-back window and the number of its steps to an array of the same length.
ExtraFeature = Callable[[Column, int], Column]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate value once per row and hand it on.

    The optimiser inlines a column that a lambda mentions once, and would then compute it anew for
    every element; a lambda variable stays computed.
    """
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def window_moments(v: Column) -> Column:
    """Struct of mean and population deviation (std).

    The mean is taken around the first element, so a constant vector gives exactly its value and a
    deviation of exactly 0.
    """

    def around(x: Column, first: Column) -> Column:
        return first + F.aggregate(x, F.lit(0.0), lambda s, e: s + (e - first)) / F.size(x)

    def spread(x: Column, mean: Column) -> Column:
        squares = F.aggregate(x, F.lit(0.0), lambda s, e: s + (e - mean) * (e - mean))
        return F.sqrt(squares / F.size(x))

    return let(
        v,
        lambda x: let(
            around(x, F.element_at(x, 1)),
            lambda mean: F.struct(mean.alias("mean"), spread(x, mean).alias("std")),
        ),
    )


def standardise(v: Column, mean: Column, std: Column) -> Column:
    """(v - mean) / std per element; NULL where std is 0."""
    pair = F.struct(mean.alias("mean"), std.alias("std"))
    return let(pair, lambda m: F.transform(v, lambda x: F.try_divide(x - m["mean"], m["std"])))


def one_step_change(v: Column, steps: int | None = None) -> Column:
    """Change from the previous element inside the window; the first element gets 0."""
    shifted = F.concat(F.slice(v, 1, 1), F.slice(v, 1, F.size(v) - 1))
    return F.zip_with(v, shifted, lambda now, before: now - before)
