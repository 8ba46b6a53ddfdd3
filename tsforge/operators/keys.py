"""Joins on group keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.session import task_count


def key(columns: Sequence[str]) -> Column:
    """The columns as one value. Structs are equal when their NULL fields agree."""
    return F.struct(*columns)


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", spread: bool = False
) -> DataFrame:
    """Join that matches NULL keys to NULL keys; the key columns are those of the left side.

    The key is never NULL, so the optimiser adds no filter to one side only, and two branches of the
    same source stay equal and share their scan and shuffle. With spread both sides are partitioned
    into a number of partitions that follows the input's size and that adaptive execution leaves alone:
    for joins whose small result is multiplied afterwards.
    """
    rest = [c for c in right.columns if c not in keys]
    left_keyed = left.withColumn("_key", key(keys))
    right_keyed = right.select(key(keys).alias("_key"), *rest)
    if spread:
        wanted = max(task_count(left), task_count(right))
        left_keyed, right_keyed = left_keyed.repartition(wanted, "_key"), right_keyed.repartition(wanted, "_key")
    return left_keyed.join(right_keyed, "_key", how).drop("_key")
