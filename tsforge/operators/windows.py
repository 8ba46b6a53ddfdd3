"""Look-back windows and look-ahead targets over dense day signals.

A day is bounded (1,440 minute slots), so it may travel as one row of parallel arrays; windows are
slices of those arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.operators.grid import DAY_KEYS

SIGNALS = ("price", "volume", "sine", "cosine")


def day_arrays(rows: DataFrame, keys: Sequence[str] = DAY_KEYS) -> DataFrame:
    """Per trading day the observed prices, volumes and timestamps in time order."""
    packed = F.sort_array(F.collect_list(F.struct("timestamp", "lhc", "volume")))
    return rows.groupBy(*keys).agg(packed.alias("_d")).select(
        *keys,
        F.col("_d.lhc").alias("price"),
        F.col("_d.volume").alias("volume"),
        F.col("_d.timestamp").alias("timestamp"),
    )


def day_lengths(rows: DataFrame, keys: Sequence[str] = DAY_KEYS) -> DataFrame:
    """Observations per day, with the least length and 1 + the greatest over all days."""
    lengths = rows.groupBy(*keys).agg(F.count("*").alias("array_length"))
    return with_constants(
        lengths,
        lengths.agg(
            F.min("array_length").alias("min_array_length"),
            (F.max("array_length") + 1).alias("max_array_length"),
        ),
    )


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row, as one scalar subquery."""
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_row", row).select(*df.columns, *(f"_row.{c}" for c in one_row.columns))


def day_signals(
    sparse: DataFrame, signals: Sequence[str] = SIGNALS, keys: Sequence[str] = DAY_KEYS, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per day with dense, interpolated signal arrays, straight from placed observations.

    Columns in keep have one value a day and are carried along.

    Equal to regular_grid, interpolate_linear and collecting the slots, but each observation builds
    its own stretch up to the next one, so there is neither a spine nor a join. Observations must be
    known on every listed slot (length_consistent_days sees to that).
    """
    order = Window.partitionBy(*keys).orderBy("slot")
    after = F.lead(F.struct("slot", *signals)).over(order)
    is_first = F.lag("slot").over(order).isNull()
    rows = sparse.withColumn("_next", after).withColumn("_lead", F.when(is_first, F.col("slot")).otherwise(0))
    ahead = F.coalesce(F.col("_next.slot") - F.col("slot"), F.lit(1))

    def stretch(v: str) -> Column:
        here = F.col(v).cast("double")
        there = F.coalesce(F.col(f"_next.{v}").cast("double"), here)
        filled = F.transform(
            F.sequence(F.lit(0), ahead - 1), lambda k: here + (there - here) * k / ahead
        )
        return F.concat(F.array_repeat(here, F.col("_lead")), filled).alias(v)

    stretches = rows.select(*keys, "slot", *keep, *(stretch(v) for v in signals))
    packed = F.sort_array(F.collect_list(F.struct("slot", *signals)))
    return stretches.groupBy(*keys).agg(packed.alias("_d"), *(F.min(c).alias(c) for c in keep)).select(
        *keys, *keep, *(F.flatten(F.col(f"_d.{v}")).alias(v) for v in signals)
    )


def collect_day_signals(
    grid: DataFrame, signals: Sequence[str] = SIGNALS, keys: Sequence[str] = DAY_KEYS
) -> DataFrame:
    """One row per day from a dense row-form grid."""
    packed = F.sort_array(F.collect_list(F.struct("slot", *signals)))
    return grid.groupBy(*keys).agg(packed.alias("_d")).select(
        *keys, *(F.col(f"_d.{v}").alias(v) for v in signals)
    )


def sample_index(
    days: DataFrame, n_back: int, n_forward: int, tail_guard: int | None = None, n_slots: Column | None = None
) -> DataFrame:
    """One row per sample: sample_slot is the first look-ahead slot of a window.

    Slots run from n_back up to, not including, length - tail_guard - n_forward. The published rule
    has tail_guard = n_back; 0 gives every complete window.
    """
    guard = n_back if tail_guard is None else tail_guard
    last = (F.size("price") if n_slots is None else n_slots) - guard - n_forward - 1
    return days.filter(last >= n_back).withColumn(
        "sample_slot", F.explode(F.sequence(F.lit(n_back), last))
    )


def lookback(signal: str, n_back: int) -> Column:
    """The n_back values before the sample slot."""
    return F.slice(signal, F.col("sample_slot") - n_back + 1, n_back)


def lookahead(signal: str, n_forward: int) -> Column:
    """The n_forward values from the sample slot on."""
    return F.slice(signal, F.col("sample_slot") + 1, n_forward)


def lookback_windows(
    days: DataFrame,
    n_back: int,
    n_forward: int,
    tail_guard: int | None = None,
    signals: Sequence[str] = SIGNALS,
    keys: Sequence[str] = DAY_KEYS,
) -> DataFrame:
    """Look-back arrays of every signal, and the price path ahead, per sample."""
    samples = sample_index(days, n_back, n_forward, tail_guard)
    return cut_windows(samples, n_back, n_forward, signals, keys)


def cut_windows(
    samples: DataFrame,
    n_back: int,
    n_forward: int,
    signals: Sequence[str] = SIGNALS,
    keys: Sequence[str] = DAY_KEYS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Slice the day arrays at every sample slot."""
    return samples.select(
        *keys,
        "sample_slot",
        *keep,
        *(lookback(v, n_back).alias(f"x_{v}") for v in signals),
        lookahead("price", n_forward).alias("y_path"),
    )


def with_lookahead_minmax(windows: DataFrame) -> DataFrame:
    """Least and greatest price of the path ahead."""
    return windows.withColumn("y_min", F.array_min("y_path")).withColumn("y_max", F.array_max("y_path"))


def rolling_targets(
    grid: DataFrame, n_back: int, n_forward: int, value: str = "price", keys: Sequence[str] = DAY_KEYS
) -> DataFrame:
    """Row form of look-back moments and look-ahead extremes for every slot with complete frames."""
    order = Window.partitionBy(*keys).orderBy("slot")
    back = order.rowsBetween(-n_back, -1)
    ahead = order.rowsBetween(0, n_forward - 1)
    frames = grid.withColumns({
        "n_seen": F.count(value).over(back),
        "n_ahead": F.count(value).over(ahead),
        "x_mean": F.avg(value).over(back),
        "x_std": F.stddev_pop(value).over(back),
        "y_min": F.min(value).over(ahead),
        "y_max": F.max(value).over(ahead),
    })
    return frames.filter((F.col("n_seen") == n_back) & (F.col("n_ahead") == n_forward)).drop(
        "n_seen", "n_ahead"
    )
