"""Lags and differences along regular series of any length."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def with_neighbours(
    series: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, int]],
    position: str = "bin",
    block: int = BLOCK,
) -> DataFrame:
    """Add columns {new: (column, offset)}: the column's value `offset` rows later (earlier if < 0).

    The series must be regular: one row per position, no position left out. It is cut into blocks
    that are processed apart, so one long series uses many tasks; rows near a border are also sent
    to the neighbouring block and dropped there afterwards.
    """
    back = max([0, *(-o for _, o in wanted.values())])
    ahead = max([0, *(o for _, o in wanted.values())])
    block = max(block, back, ahead)  # a neighbour is in this block or the next
    at = F.pmod(F.col(position), F.lit(block))
    home = F.floor(F.col(position) / F.lit(block))
    blocks = F.array_compact(
        F.array(home, F.when(at >= block - back, home + 1), F.when(at < ahead, home - 1))
    )
    spread = series.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    order = Window.partitionBy(*keys, "_block").orderBy(position)
    added = {new: F.lead(c, o).over(order) if o >= 0 else F.lag(c, -o).over(order)
             for new, (c, o) in wanted.items()}
    return spread.withColumns(added).filter("_block = _home").drop("_home", "_block")


def lag_difference(
    series: DataFrame, keys: Sequence[str], value: str, d: int, position: str = "bin", name: str = "diff"
) -> DataFrame:
    """x[t] - x[t + d], the difference to the value d rows later; d = 0 is the series itself."""
    if d == 0:
        return series.withColumn(name, F.col(value))
    near = with_neighbours(series, keys, {"_later": (value, d)}, position)
    return near.withColumn(name, F.col(value) - F.col("_later")).drop("_later")


def binomial_difference(value: str, d: int) -> Column:
    """d-fold difference from the value and its lags _lag1.._lagd."""
    terms = [F.col(value)] + [F.col(f"_lag{k}") * float((-1) ** k * comb(d, k)) for k in range(1, d + 1)]
    return sum(terms[1:], terms[0])


def iterated_difference(
    series: DataFrame, keys: Sequence[str], value: str, orders: Sequence[int], position: str = "bin"
) -> DataFrame:
    """d-fold differences for several d at once, in long form with columns d and diff."""
    top = max(orders)
    near = with_neighbours(series, keys, {f"_lag{k}": (value, -k) for k in range(1, top + 1)}, position)
    each = F.array(*(
        F.struct(F.lit(d).alias("d"), binomial_difference(value, d).alias("diff")) for d in orders
    ))
    kept = [c for c in series.columns]
    return near.select(*kept, F.inline(each))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.dropna(subset=[column])
