"""Exact positions in a total order, and what follows from them: sampling, shuffling, splitting.

A position is the number of rows before a row. It is built from counts: rows are numbered inside
small buckets, and each bucket starts where the ones before it end. No task sees the whole data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.config import SPLIT_ORDER
from tsforge.operators.keys import join_on, key


def global_position(
    df: DataFrame,
    levels: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    within: Sequence[str] = (),
) -> DataFrame:
    """0-based position in the order (levels, order), restarting for every `within` group.

    Choose levels so that each has few distinct values per value of the level above, and so that
    the rows of one value of the last level are bounded, for example (date, instrument).
    """
    counts = df.groupBy(*within, *levels).agg(F.count("*").alias("_rows"))
    starts = None
    for depth in range(1, len(levels) + 1):
        columns = [*within, *levels[:depth]]
        upper = columns[:-1]
        sums = counts.groupBy(*columns).agg(F.sum("_rows").alias("_rows"))
        window = Window.partitionBy(*upper) if upper else Window.partitionBy()
        before = window.orderBy(levels[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        step = sums.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        if starts is None:
            starts = step.drop("_rows")
        else:
            above = starts.withColumnRenamed("_start", "_above")
            starts = join_on(step, above, upper).select(
                *columns, (F.col("_start") + F.col("_above")).alias("_start")
            )
    full = [*within, *levels]
    inside = Window.partitionBy("_key").orderBy(*order)
    numbered = df.withColumn("_key", key(full)).withColumn("_at", F.row_number().over(inside) - 1)
    # Numbering and join partition by the same key: one shuffle of the rows.
    return (
        numbered.join(starts.select(key(full).alias("_key"), "_start"), "_key")
        .withColumn(name, F.col("_start") + F.col("_at"))
        .drop("_key", "_start", "_at")
    )


def every_kth(positioned: DataFrame, k: int, name: str = "position") -> DataFrame:
    """Rows whose position is a multiple of k."""
    return positioned.filter(F.col(name) % k == 0)


def shuffle_key(seed: int, keys: Sequence[str]) -> Column:
    """Hash that orders rows at random: the same for any partitioning, different for every seed."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def seeded_shuffle(
    df: DataFrame, seed: int, keys: Sequence[str], name: str = "position", digits: int = 4
) -> DataFrame:
    """Position of every row in a random order fixed by the seed and the unique key.

    The first hex digits of the hash are the buckets (65,536 by default), which are of even size
    whatever the data. Whole rows move, so all columns stay aligned.
    """
    hashed = df.withColumn("_hash", shuffle_key(seed, keys)).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    return global_position(hashed, ["_bucket"], ["_hash", *keys], name).drop("_hash", "_bucket")


def split_fractions(
    positioned: DataFrame, fractions: Mapping[str, float], n: Column, name: str = "position"
) -> DataFrame:
    """Consecutive sets of int(fraction * n) rows; the few rows left over have no set (NULL)."""
    start = F.lit(0).cast("long")
    split = None
    for group in SPLIT_ORDER:
        end = start + F.floor(F.lit(float(fractions[group])) * n)
        here = (F.col(name) >= start) & (F.col(name) < end)
        split = F.when(here, F.lit(group)) if split is None else split.when(here, F.lit(group))
        start = end
    return positioned.withColumn("split", split)


def chronological_split(
    series: DataFrame, fraction: float, keys: Sequence[str], position: str = "bin"
) -> DataFrame:
    """First round-half-even(fraction * n) rows of each regular series train, all the rest test.

    The bin number of a regular series is its position, so only one count per series is shuffled.
    """
    n = series.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return (
        join_on(series, n, keys)
        .withColumn("n_train", F.rint(F.lit(fraction) * F.col("n_rows")).cast("long"))
        .withColumn("split", F.when(F.col(position) < F.col("n_train"), "train").otherwise("test"))
    )


def tail_holdout(
    positioned: DataFrame, fraction: float, n: Column, name: str = "position"
) -> DataFrame:
    """Mark the last `fraction` of the rows as validation: those from int(n * (1 - fraction)) on."""
    cut = F.floor(n * F.lit(1.0 - fraction))
    return positioned.withColumn("split", F.when(F.col(name) < cut, "train").otherwise("val"))
