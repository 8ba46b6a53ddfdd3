"""Irregular observations to regular slots: placing, gridding, trimming and filling.

Day operators work per (instrument, session_date). Bars are unique per instrument and epoch second,
so such a group has at most 86,400 rows before slots are assigned and 1,440 minute slots after.
Series operators (resample_mean, fill_series) take groups of any length and split them into blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tsforge.functions.clock import SECONDS_PER_DAY, epoch_seconds, utc_wall_time
from tsforge.functions.numeric import whole_steps
from tsforge.operators.keys import join_on, key
from tsforge.operators.lags import BLOCK
from tsforge.session import task_count

DAY_KEYS = ("instrument", "session_date")


def spread_days(rows: DataFrame, keys: Sequence[str] = DAY_KEYS) -> DataFrame:
    """Partition by day into as many partitions as the input's size asks for.

    The steps that follow multiply each row (slots, then windows). Adaptive execution would merge
    partitions by the small size before that; an explicit number is left alone. All day operators
    work on this partitioning without another shuffle.
    """
    return rows.repartition(task_count(rows), *keys)


def length_consistent_days(aligned: DataFrame, keys: Sequence[str] = DAY_KEYS) -> DataFrame:
    """Rows of the days on which price, volume and timestamp are known equally often."""
    # The order is not needed for a count; it lets the day operators share one sort.
    order = Window.partitionBy(*keys).orderBy("timestamp")
    day = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        aligned.withColumn("_p", F.count("lhc").over(day))
        .withColumn("_v", F.count("volume").over(day))
        .withColumn("_t", F.count("timestamp").over(day))
        .filter("_p = _v and _p = _t")
        .drop("_p", "_v", "_t")
    )


def timestamp_diffs(rows: DataFrame, divisor: int, keys: Sequence[str] = DAY_KEYS) -> DataFrame:
    """Whole steps since the previous observation of the day; the first one has none."""
    order = Window.partitionBy(*keys).orderBy("timestamp")
    step = whole_steps(F.col("timestamp"), F.lag("timestamp").over(order), divisor)
    return rows.withColumn("diff_timestamp", step)


def place_on_slots(
    rows: DataFrame,
    values: Sequence[str],
    divisor: int,
    rule: str = "next",
    keys: Sequence[str] = DAY_KEYS,
) -> DataFrame:
    """Slot number of every observation; the later one wins when two share a slot.

    rule 'next': an observation sits at the end of the gap that follows it, so the last one of the
    day has no slot, and one whose gap is shorter than a step falls before the first slot and goes.
    rule 'own': an observation sits where its own time falls, and every one is kept.
    """
    order = Window.partitionBy(*keys).orderBy("timestamp")
    if rule == "next":
        gap = whole_steps(F.lead("timestamp").over(order), F.col("timestamp"), divisor)
        running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = (
            rows.withColumn("_gap", gap)
            .withColumn("slot", F.sum("_gap").over(running) - 1)
            .filter("_gap is not null and slot >= 0")
        )
    elif rule == "own":
        start = F.first("timestamp").over(order)
        placed = rows.withColumn("slot", F.floor((F.col("timestamp") - start) / F.lit(divisor)))
    else:
        raise ValueError(f"unknown slot rule {rule!r}")
    # Same partitioning as the windows above, so no further shuffle.
    return placed.groupBy(*keys, F.col("slot").cast("int").alias("slot")).agg(
        *(F.max_by(v, "timestamp").alias(v) for v in values)
    )


def timestamp_spine_join(rows: DataFrame, on: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Distinct instants full-outer-joined to the rows, as the basis of a complete time axis.

    Every row finds its instant, except that a NULL instant matches nothing on either side. So the
    join is a right outer one, which adaptive execution can split at a hot instant, plus the one
    unmatched instant.
    """
    spine = rows.select(*on).distinct()
    matched = spine.join(rows, list(on), "right")
    unmatched = spine.filter(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in on)))
    return matched.unionByName(unmatched, allowMissingColumns=True)


def regular_grid(
    sparse: DataFrame, last: Column | None = None, keys: Sequence[str] = DAY_KEYS
) -> DataFrame:
    """Every slot from 0 to the last one of the group (or to `last`); unknown values are NULL.

    Each row emits its own slot and the empty ones up to the next row, so no spine has to be joined
    and the partitioning by group is kept.
    """
    order = Window.partitionBy(*keys).orderBy("slot")
    values = [c for c in sparse.columns if c not in (*keys, "slot")]
    end = F.col("slot") if last is None else F.greatest(F.col("slot"), last)
    bounded = sparse.withColumns({
        "_to": F.coalesce(F.lead("slot").over(order) - 1, end).cast("int"),
        "_from": F.when(F.lag("slot").over(order).isNull(), F.lit(0)).otherwise(F.col("slot")),
    })
    own = F.col("_slot") == F.col("slot")
    return bounded.withColumn("_slot", F.explode(F.sequence("_from", "_to"))).select(
        *keys, F.col("_slot").alias("slot"), *(F.when(own, F.col(v)).alias(v) for v in values)
    )


def trim_trailing(grid: DataFrame, value: str, keys: Sequence[str] = DAY_KEYS) -> DataFrame:
    """Drop the slots after the last known value of the group."""
    known = F.when(F.col(value).isNotNull(), F.col("slot"))
    last = F.max(known).over(Window.partitionBy(*keys))
    return grid.withColumn("_last", last).filter("slot <= _last").drop("_last")


def between_known(before: Column, after: Column, at: Column) -> Column:
    """Linear value at a position from (position, value) structs of the neighbours; holds the edge."""
    rise = (after["v"] - before["v"]) * (at - before["i"])
    return (
        F.when(before.isNull(), after["v"])
        .when(after.isNull() | (before["i"] == after["i"]), before["v"])
        .otherwise(before["v"] + F.try_divide(rise, after["i"] - before["i"]))
    )


def _both_ways(keys: Sequence[str], position: str) -> tuple[WindowSpec, WindowSpec]:
    """Running frames up to a row from the front and from the back.

    A frame that ends at the last row would be read anew for every row; running over the reversed
    order costs one more sort but reads each row once.
    """
    def running(order: Column) -> WindowSpec:
        window = Window.partitionBy(*keys).orderBy(order)
        return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    return running(F.col(position).asc()), running(F.col(position).desc())


def interpolate_linear(
    grid: DataFrame, values: Sequence[str], keys: Sequence[str] = DAY_KEYS, position: str = "slot"
) -> DataFrame:
    """Fill NULL linearly by position within a group of bounded size; edges hold the nearest value."""
    back, ahead = _both_ways(keys, position)
    here = F.col(position)
    filled = {}
    for v in values:
        point = F.when(F.col(v).isNotNull(), F.struct(here.alias("i"), F.col(v).cast("double").alias("v")))
        before = F.last(point, ignorenulls=True).over(back)
        after = F.last(point, ignorenulls=True).over(ahead)
        filled[v] = between_known(before, after, here)
    return grid.withColumns(filled)


def fill_series(
    grid: DataFrame, value: str, keys: Sequence[str], position: str = "bin", block: int = BLOCK
) -> DataFrame:
    """interpolate_linear for groups of any length.

    Positions are cut into blocks. Only the first and last known point of each block cross block
    borders, so a long group is spread over as many tasks as it has blocks.
    """
    rows = grid.withColumn("_block", F.floor(F.col(position) / F.lit(block)))
    here = F.col(position)
    point = F.when(
        F.col(value).isNotNull(), F.struct(here.alias("i"), F.col(value).cast("double").alias("v"))
    )
    edges = rows.withColumn("_pt", point).groupBy(*keys, "_block").agg(
        F.min("_pt").alias("_first"), F.max("_pt").alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy(F.col("_block").asc())
    later = Window.partitionBy(*keys).orderBy(F.col("_block").desc())
    others = (Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys,
        "_block",
        F.last("_last", ignorenulls=True).over(earlier.rowsBetween(*others)).alias("_from"),
        F.last("_first", ignorenulls=True).over(later.rowsBetween(*others)).alias("_to"),
    )
    back, ahead = _both_ways([*keys, "_block"], position)
    before = F.coalesce(F.last(point, ignorenulls=True).over(back), F.col("_from"))
    after = F.coalesce(F.last(point, ignorenulls=True).over(ahead), F.col("_to"))
    return (
        join_on(rows, carried, [*keys, "_block"])
        .withColumn(value, between_known(before, after, here))
        .select(*grid.columns)
    )


def resample_mean(
    records: DataFrame,
    keys: Sequence[str],
    bin_seconds: int,
    ts: str = "Timestamp",
    value: str = "price",
    name: str = "spot_price",
    block: int = BLOCK,
) -> DataFrame:
    """Mean per fixed-width bin; empty bins between the first and last are rows with NULL.

    Bins are counted from midnight of the first day of the group. Adds bin, 0 for the first one.
    Records are summed into units that divide both a bin and a day before anything else is done, so
    a hot series is reduced on the map side, and its start is found from the sums.
    """
    unit = gcd(bin_seconds, SECONDS_PER_DAY)
    units = records.withColumn("_unit", F.floor(epoch_seconds(ts) / F.lit(unit)))
    sums = (
        units.groupBy(key([*keys, "_unit"]).alias("_key"))
        .agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
        .select("_key.*", "_sum", "_n")
    )
    # Both columns are read here too, so that this branch and the other share scan and shuffle.
    known = F.count(F.when(F.col("_n") > 0, F.col("_sum")))
    ends = sums.groupBy(*keys).agg(
        F.min("_unit").alias("_lo"), F.max("_unit").alias("_hi"), known.alias("_known")
    ).filter("_known >= 0")
    origin = F.floor(F.col("_lo") * F.lit(unit) / SECONDS_PER_DAY) * SECONDS_PER_DAY

    def number(of: str) -> Column:
        return F.floor((F.col(of) * F.lit(unit) - F.col("_origin")) / F.lit(bin_seconds))

    span = ends.withColumn("_origin", origin).select(
        *keys, "_origin", number("_lo").alias("_first"), number("_hi").alias("_last")
    )
    if unit == bin_seconds:
        spine_key = (F.col("_origin") / F.lit(unit)).cast("long") + F.col("_bin")
        means = sums.select(*keys, "_unit", F.try_divide("_sum", "_n").alias(name))
    else:
        spine_key = F.col("_bin")
        means = (
            join_on(sums, span, keys)
            .groupBy(*keys, number("_unit").alias("_unit"))
            .agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias(name))
        )
    wide = F.lit(block)
    blocks = F.sequence(F.floor(F.col("_first") / wide), F.floor(F.col("_last") / wide))
    inside = F.sequence(
        F.greatest(F.col("_first"), F.col("_block") * wide),
        F.least(F.col("_last"), F.col("_block") * wide + wide - 1),
    )
    spine = (
        span.withColumn("_block", F.explode(blocks))
        .withColumn("_bin", F.explode(inside))
        .withColumn("_unit", spine_key)
        .drop("_block", "_last")
    )
    return join_on(spine, means, [*keys, "_unit"], "left").select(
        *keys,
        utc_wall_time(F.col("_origin") + F.col("_bin") * F.lit(bin_seconds)).alias(ts),
        (F.col("_bin") - F.col("_first")).alias("bin"),
        name,
    )
