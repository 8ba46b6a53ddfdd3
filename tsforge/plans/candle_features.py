"""Bars to scaled, split feature tensors as one chain of DataFrame steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.config import PrepConfig
from tsforge.functions.numeric import day_cosine, day_sine
from tsforge.functions.vectors import ExtraFeature, one_step_change
from tsforge.operators.calendar import align
from tsforge.operators.grid import DAY_KEYS, length_consistent_days, place_on_slots, spread_days
from tsforge.operators.keys import join_on
from tsforge.operators.position import every_kth, global_position, seeded_shuffle, split_fractions
from tsforge.operators.scaling import feature_tensor, scale_samples
from tsforge.operators.windows import (
    SIGNALS,
    cut_windows,
    day_signals,
    sample_index,
    with_lookahead_minmax,
)
from tsforge.session import stored
from tsforge.sources.candles import CandleStar, candle_scan

DAY_START, N_SLOTS = "day_start", "n_slots"


@dataclass(frozen=True)
class CandleFeatures:
    """Stages of the pipeline; all but days are lazy."""

    aligned: DataFrame
    days: DataFrame
    index: DataFrame
    samples: DataFrame


def with_signals(aligned: DataFrame) -> DataFrame:
    """Aligned rows of consistent days with the four signals that get windows, and the epoch of the day's slot 0."""
    day = Window.partitionBy(*DAY_KEYS).orderBy("timestamp").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return length_consistent_days(spread_days(aligned)).select(
        *DAY_KEYS,
        "timestamp",
        F.min("timestamp").over(day).alias(DAY_START),
        F.col("lhc").alias("price"),
        "volume",
        day_sine("timestamp").alias("sine"),
        day_cosine("timestamp").alias("cosine"),
    )


def placed_signals(aligned: DataFrame, config: PrepConfig) -> DataFrame:
    return place_on_slots(with_signals(aligned), (*SIGNALS, DAY_START), config.seconds_divisor, config.slot_rule)


def chosen_samples(days: DataFrame, config: PrepConfig) -> DataFrame:
    """Key, position and split of every sample that is kept, before any window is cut."""
    keys = [*DAY_KEYS, "sample_slot"]
    # Lengths only: of stored days no array is read here.
    days = days.select(*DAY_KEYS, N_SLOTS)
    index = sample_index(days, config.n_back, config.n_forward, config.guard, F.col(N_SLOTS)).select(*keys)
    if config.shuffle_it:
        placed = seeded_shuffle(index, config.seed, keys)
    else:
        placed = global_position(index, ["session_date", "instrument"], ["sample_slot"])
    windows = F.greatest(
        F.col(N_SLOTS) - config.guard - config.n_forward - config.n_back, F.lit(0)
    ).cast("long")
    total = days.agg(F.coalesce(F.sum(windows), F.lit(0).cast("long")).alias("n"))
    if config.reduce_vector_sizes:
        k = config.modulus_integer
        placed = every_kth(placed, k).withColumn("position", F.floor(F.col("position") / k))
        total = total.select(F.ceil(F.col("n") / k).alias("n"))
    return split_fractions(placed, config.train_val_test_split, total.scalar())


def feature_samples(
    days: DataFrame, index: DataFrame, config: PrepConfig, extra: ExtraFeature = one_step_change
) -> DataFrame:
    """Scaled windows of the chosen samples; sample_epoch is the time of the first slot ahead.

    The chosen slots of a day travel to its arrays as one list, at most one entry per slot, so the
    arrays are shuffled once and windows are cut for kept samples only.
    """
    per_day = index.groupBy(*DAY_KEYS).agg(
        F.collect_list(F.struct("sample_slot", "position", "split")).alias("_chosen")
    )
    days = days.drop(N_SLOTS)
    samples = join_on(days, per_day, DAY_KEYS, spread=True).select(*days.columns, F.inline("_chosen"))
    # Slot k of a day lies k steps after its first bar, under either slot rule.
    epoch = F.col(DAY_START) + F.col("sample_slot").cast("long") * config.seconds_divisor
    timed = samples.withColumn("sample_epoch", epoch)
    windows = cut_windows(timed, config.n_back, config.n_forward, keep=("sample_epoch", "position", "split"))
    return scale_samples(with_lookahead_minmax(windows), extra, config.n_back)


def prepare(
    bars: DataFrame,
    lookup: DataFrame,
    config: PrepConfig,
    extra: ExtraFeature = one_step_change,
    materialise: bool = True,
) -> CandleFeatures:
    """Run the pipeline on bars of one price type and interval, any number of instruments.

    The day arrays feed both the numbering of samples and the windows. With materialise they are
    written once to the shared folder instead of being computed twice.
    """
    aligned = align(bars, lookup, config.tz)
    days = day_signals(placed_signals(aligned, config), keep=(DAY_START,)).withColumn(N_SLOTS, F.size("price"))
    if materialise:
        days = stored(days, "days")
    index = chosen_samples(days, config)
    samples = feature_tensor(feature_samples(days, index, config, extra))
    return CandleFeatures(aligned, days, index, samples)


def prepare_from_star(
    star: CandleStar, lookup: DataFrame, config: PrepConfig, extra: ExtraFeature = one_step_change
) -> CandleFeatures:
    """The same from the star schema, for the instrument, price type and interval of the config."""
    if config.instrument_name is None:
        raise ValueError("config.instrument_name is needed to scan the star schema")
    bars = candle_scan(star, config.price_type_name, config.instrument_name, config.interval_name)
    return prepare(bars, lookup, config, extra)


def tag_run(samples: DataFrame, run_id: str) -> DataFrame:
    """Attach the id of the preparation run."""
    return samples.withColumn("run_id", F.lit(run_id))
