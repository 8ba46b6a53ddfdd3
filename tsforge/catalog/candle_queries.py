"""Registered queries of the candlestick pipeline."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.catalog import fixtures as fx
from tsforge.catalog.registry import n, query, r, single
from tsforge.catalog.sql import FREQ, ROOT2
from tsforge.functions.clock import epoch_seconds, local_wall_time, weekday_monday0
from tsforge.functions.matrix import matrix_feature, step_changes
from tsforge.functions.numeric import day_cosine, day_sine, mean_of_present
from tsforge.functions.vectors import one_step_change
from tsforge.operators.baseline import window_regression
from tsforge.operators.calendar import (
    aligned_columns,
    join_shift_lookup,
    session_date_by_join,
    with_local_time,
)
from tsforge.operators.grid import (
    DAY_KEYS,
    interpolate_linear,
    length_consistent_days,
    place_on_slots,
    regular_grid,
    timestamp_diffs,
    timestamp_spine_join,
    trim_trailing,
)
from tsforge.operators.position import (
    every_kth,
    global_position,
    seeded_shuffle,
    split_fractions,
    tail_holdout,
)
from tsforge.operators.quality import (
    missing_profile,
    nan_count,
    null_cells_total,
    row_counts,
    rows_with_any_null,
)
from tsforge.operators.scaling import (
    feature_vectors,
    tensor_long,
    tensor_shape,
    unscale,
    with_extra_feature,
    with_moments,
    zscore_window,
    scale_path,
    scale_targets,
)
from tsforge.operators.windows import (
    SIGNALS,
    day_arrays,
    day_lengths,
    lookback_windows,
    rolling_targets,
    with_constants,
    with_lookahead_minmax,
)
from tsforge.plans.candle_features import prepare, tag_run, with_signals
from tsforge.session import scratch_path
from tsforge.sources.candles import candle_scan, duplicate_bars, star_join, store_star
from tsforge.sources.lookup import shift_lookup_scan
from tsforge.sources.splits import read_splits, split_summary, write_splits

SAMPLE = ("instrument", "session_date", "sample_slot")
KEYS_SQL = "instrument, session_date, CAST(sample_slot AS BIGINT) AS sample_slot"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.HOURLY
    return with_lookahead_minmax(lookback_windows(fx.days(spark, sf_dir), c.n_back, c.n_forward))


def _prepared(spark: SparkSession, sf_dir: str, **changes):
    config = replace(fx.HOURLY, **changes)
    return prepare(fx.bars(spark, sf_dir), fx.shift_lookup(spark), config)


def _sample_keys():
    return [F.col("instrument"), F.col("session_date"), n("sample_slot")]


# --- sources ---


@query(
    "bars_from_events",
    """SELECT instrument, timestamp, o, l, h, c, volume FROM bars_minute""",
)
def _(spark, sf_dir):
    return fx.bars(spark, sf_dir, "Minute").select("instrument", "timestamp", "o", "l", "h", "c", n("volume"))


@query(
    "candle_scan",
    """SELECT instrument, timestamp, o, l, h, c, volume FROM bars_hour WHERE instrument = 'click'
       ORDER BY timestamp""",
)
def _(spark, sf_dir):
    bars = candle_scan(fx.star(spark, sf_dir), "mid", "click", "Hour")
    return bars.select("instrument", "timestamp", "o", "l", "h", "c", n("volume")).orderBy("timestamp")


@query(
    "star_join",
    """SELECT 'mid' AS price_type, 'Hour' AS "interval", instrument, timestamp, o, l, h, c, volume
       FROM bars_hour""",
)
def _(spark, sf_dir):
    return star_join(fx.star(spark, sf_dir)).select(
        "price_type", "interval", "instrument", "timestamp", "o", "l", "h", "c", n("volume")
    )


@query(
    "star_join_stored",
    """SELECT 'mid' AS price_type, 'Hour' AS "interval", instrument, timestamp, o, l, h, c, volume
       FROM bars_hour""",
)
def _(spark, sf_dir):
    return star_join(store_star(fx.star(spark, sf_dir))).select(
        "price_type", "interval", "instrument", "timestamp", "o", "l", "h", "c", n("volume")
    )


@query(
    "duplicate_bars",
    """SELECT instrument, timestamp, count(*) AS n
       FROM (SELECT event_type AS instrument, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS timestamp
             FROM events) GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(spark, sf_dir):
    # Raw events are bars that break the key: one candlestick per event.
    events = fx.table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    fact = events.select(
        epoch_seconds(hour).alias("timestamp_id"),
        F.col("event_type").alias("instrument_id"),
        F.lit(1).alias("price_type_id"),
        F.lit(3600).alias("interval_id"),
    )
    return duplicate_bars(fact).select(
        F.col("instrument_id").alias("instrument"), F.col("timestamp_id").alias("timestamp"), "n"
    )


@query(
    "shift_lookup_scan",
    """SELECT CAST(weekday_tz AS BIGINT) AS weekday_tz, CAST(hour_tz AS BIGINT) AS hour_tz,
              CAST(any_value(weekday_shifted) AS BIGINT) AS weekday_shifted, count(*) AS n_bars
       FROM aligned_minute GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "lookup")
    fx.shift_lookup(spark).write.option("header", True).csv(path)
    local = with_local_time(fx.bars(spark, sf_dir, "Minute"), fx.TZ)
    used = join_shift_lookup(local, shift_lookup_scan(spark, path))
    return used.groupBy(n("weekday_tz"), n("hour_tz"), n("weekday_shifted")).agg(
        F.count("*").alias("n_bars")
    )


@query(
    "split_sink",
    """SELECT split, count(*) AS n, min(position) AS position FROM (
         SELECT position, CASE WHEN position < a THEN 'train' WHEN position < a + b THEN 'val'
                               WHEN position < a + 2 * b THEN 'test' END AS split
         FROM (SELECT row_number() OVER (ORDER BY session_date, instrument, sample_slot) - 1 AS position,
                      floor(CAST(0.75 AS DOUBLE) * count(*) OVER ()) AS a,
                      floor(CAST(0.125 AS DOUBLE) * count(*) OVER ()) AS b FROM samples_hour))
       WHERE split IS NOT NULL GROUP BY 1""",
)
def _(spark, sf_dir):
    samples = _prepared(spark, sf_dir, shuffle_it=False).samples
    path = scratch_path(spark, "splits")
    write_splits(samples, path)
    return split_summary(read_splits(spark, path).filter("split is not null")).select("split", "n", "position")


# --- projections, filters, scalar functions ---


def _local(name: str, build, sql_column: str):
    @query(name, f"SELECT instrument, timestamp, {sql_column} AS {name} FROM local_minute")
    def _(spark, sf_dir):
        bars = fx.bars(spark, sf_dir, "Minute")
        return bars.select("instrument", "timestamp", build(local_wall_time("timestamp", fx.TZ)).alias(name))


_local("local_time", lambda t: t, "datetime_tz")
_local("local_weekday", lambda t: weekday_monday0(t).cast("long"), "CAST(weekday_tz AS BIGINT)")
_local("local_hour", lambda t: F.hour(t).cast("long"), "CAST(hour_tz AS BIGINT)")
_local("local_date", lambda t: F.to_date(t), "CAST(datetime_tz AS DATE)")


@query(
    "typical_price",
    "SELECT instrument, timestamp, round((l + h + c) / 3, 6) AS lhc FROM bars_minute",
)
def _(spark, sf_dir):
    bars = fx.bars(spark, sf_dir, "Minute")
    return bars.select("instrument", "timestamp", r(mean_of_present("l", "h", "c")).alias("lhc"))


@query(
    "aligned_columns",
    """SELECT instrument, timestamp, datetime_tz, CAST(weekday_tz AS BIGINT) AS weekday_tz,
              CAST(hour_tz AS BIGINT) AS hour_tz, CAST(weekday_shifted AS BIGINT) AS weekday_shifted,
              round(lhc, 6) AS lhc, volume FROM aligned_minute""",
)
def _(spark, sf_dir):
    local = with_local_time(fx.bars(spark, sf_dir, "Minute"), fx.TZ)
    return aligned_columns(join_shift_lookup(local, fx.shift_lookup(spark))).select(
        "instrument", "timestamp", "datetime_tz", n("weekday_tz"), n("hour_tz"), n("weekday_shifted"),
        r("lhc"), n("volume"),
    )


@query(
    "day_shift",
    """SELECT instrument, timestamp, CAST(weekday_shifted - weekday_tz AS BIGINT) AS to_shift
       FROM aligned_minute""",
)
def _(spark, sf_dir):
    shift = (F.col("weekday_shifted") - F.col("weekday_tz")).cast("long")
    return fx.aligned(spark, sf_dir, "Minute").select("instrument", "timestamp", shift.alias("to_shift"))


@query("session_date", "SELECT instrument, timestamp, session_date FROM aligned_minute")
def _(spark, sf_dir):
    return fx.aligned(spark, sf_dir, "Minute").select("instrument", "timestamp", "session_date")


@query(
    "length_consistent_days",
    """SELECT instrument, session_date, count(*) AS n_bars, round(sum(lhc), 4) AS total
       FROM (SELECT *, count(lhc) OVER d AS np, count(v) OVER d AS nv, count(*) OVER d AS nt
             FROM (SELECT instrument, session_date, lhc, CASE WHEN volume < 9 THEN volume END AS v
                   FROM aligned_hour)
             WINDOW d AS (PARTITION BY instrument, session_date))
       WHERE np = nv AND np = nt GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    # Busy hours count as missing, so that some days are inconsistent.
    rows = fx.aligned(spark, sf_dir).withColumn("volume", F.when(F.col("volume") < 9, F.col("volume")))
    return length_consistent_days(rows).groupBy(*DAY_KEYS).agg(
        F.count("*").alias("n_bars"), r(F.sum("lhc"), 4).alias("total")
    )


@query(
    "seasonal_terms",
    f"""SELECT instrument, timestamp,
               round(sin(timestamp * CAST({FREQ} AS DOUBLE)) * CAST({ROOT2} AS DOUBLE), 6) + 0.0 AS sine,
               round(cos(timestamp * CAST({FREQ} AS DOUBLE)) * CAST({ROOT2} AS DOUBLE), 6) + 0.0 AS cosine
        FROM bars_minute""",
)
def _(spark, sf_dir):
    # Adding 0 turns a rounded -0.0 into 0.0.
    return fx.bars(spark, sf_dir, "Minute").select(
        "instrument",
        "timestamp",
        (r(day_sine("timestamp")) + 0.0).alias("sine"),
        (r(day_cosine("timestamp")) + 0.0).alias("cosine"),
    )


@query(
    "every_kth",
    """SELECT instrument, timestamp, position FROM (
         SELECT *, row_number() OVER (ORDER BY session_date, instrument, timestamp) - 1 AS position
         FROM aligned_minute) WHERE position % 30 = 0""",
)
def _(spark, sf_dir):
    rows = fx.aligned(spark, sf_dir, "Minute").select("instrument", "session_date", "timestamp")
    placed = global_position(rows, ["session_date", "instrument"], ["timestamp"])
    return every_kth(placed, 30).select("instrument", "timestamp", "position")


@query(
    "constants_as_columns",
    """SELECT instrument, session_date, count(*) AS n_bars, min(count(*)) OVER () AS least,
              max(count(*)) OVER () AS most, CAST(60 AS BIGINT) AS seconds_divisor
       FROM aligned_minute GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    lengths = row_counts(fx.aligned(spark, sf_dir, "Minute"), *DAY_KEYS).withColumnRenamed("n", "n_bars")
    ends = lengths.agg(F.min("n_bars").alias("least"), F.max("n_bars").alias("most"))
    return with_constants(lengths, ends).withColumn("seconds_divisor", F.lit(60).cast("long"))


@query(
    "run_id",
    "SELECT instrument, timestamp, 'run-1' AS run_id FROM bars_minute",
)
def _(spark, sf_dir):
    return tag_run(fx.bars(spark, sf_dir, "Minute").select("instrument", "timestamp"), "run-1")


# --- joins ---


@query(
    "shift_lookup_join",
    """SELECT instrument, timestamp, CAST(weekday_shifted AS BIGINT) AS weekday_shifted FROM aligned_minute""",
)
def _(spark, sf_dir):
    local = with_local_time(fx.bars(spark, sf_dir, "Minute"), fx.TZ)
    return join_shift_lookup(local, fx.shift_lookup(spark)).select(
        "instrument", "timestamp", n("weekday_shifted")
    )


@query(
    "shifted_date_join",
    """SELECT a.instrument, a.timestamp, s.session_date FROM aligned_minute a
       LEFT JOIN (SELECT DISTINCT weekday_tz, hour_tz, weekday_shifted, CAST(datetime_tz AS DATE) AS d,
                         session_date FROM aligned_minute) s
       ON a.weekday_tz IS NOT DISTINCT FROM s.weekday_tz AND a.hour_tz IS NOT DISTINCT FROM s.hour_tz
          AND a.weekday_shifted IS NOT DISTINCT FROM s.weekday_shifted
          AND CAST(a.datetime_tz AS DATE) IS NOT DISTINCT FROM s.d""",
)
def _(spark, sf_dir):
    rows = fx.aligned(spark, sf_dir, "Minute").drop("session_date")
    return session_date_by_join(rows).select("instrument", "timestamp", "session_date")


@query(
    "timestamp_spine_join",
    "SELECT instrument, timestamp, round(lhc, 6) AS lhc FROM aligned_minute",
)
def _(spark, sf_dir):
    rows = fx.aligned(spark, sf_dir, "Minute")
    return timestamp_spine_join(rows, ["timestamp"]).select("instrument", "timestamp", r("lhc"))


@query(
    "regular_grid",
    """SELECT instrument, session_date, slot, round(price, 6) AS price, volume FROM grid_minute""",
)
def _(spark, sf_dir):
    return fx.grid(spark, sf_dir, fx.MINUTELY).select(*DAY_KEYS, n("slot"), r("price"), n("volume"))


# --- aggregations ---


@query(
    "day_arrays",
    """SELECT instrument, session_date, row_number() OVER (PARTITION BY instrument, session_date
              ORDER BY timestamp) - 1 AS at, round(lhc, 6) AS price, volume, timestamp
       FROM aligned_hour""",
)
def _(spark, sf_dir):
    arrays = day_arrays(length_consistent_days(fx.aligned(spark, sf_dir)))
    return arrays.select(
        *DAY_KEYS, F.posexplode(F.arrays_zip("price", "volume", "timestamp")).alias("at", "_e")
    ).select(
        *DAY_KEYS,
        n("at"),
        r(F.col("_e.price")).alias("price"),
        F.col("_e.volume").cast("long").alias("volume"),
        F.col("_e.timestamp").alias("timestamp"),
    )


@query(
    "day_lengths",
    """SELECT instrument, session_date, count(*) AS array_length, min(count(*)) OVER () AS min_array_length,
              max(count(*)) OVER () + 1 AS max_array_length FROM aligned_minute GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return day_lengths(fx.aligned(spark, sf_dir, "Minute"))


@query("distinct_rows", "SELECT DISTINCT weekday_tz::BIGINT AS weekday_tz, hour_tz::BIGINT AS hour_tz, "
       "weekday_shifted::BIGINT AS weekday_shifted, CAST(datetime_tz AS DATE) AS local_date FROM aligned_minute")
def _(spark, sf_dir):
    return fx.aligned(spark, sf_dir, "Minute").select(
        n("weekday_tz"), n("hour_tz"), n("weekday_shifted"), F.to_date("datetime_tz").alias("local_date")
    ).distinct()


@query(
    "sample_moments",
    f"""SELECT instrument, session_date, slot, CAST(CAST(x_mean AS FLOAT) AS DOUBLE) AS x_mean, round(x_std, 6) AS x_std
        FROM (SELECT *, avg(price) OVER b AS x_mean,
                     CASE WHEN min(price) OVER b = max(price) OVER b THEN 0 ELSE stddev_pop(price) OVER b END
                     AS x_std, count(*) OVER b AS nb, count(*) OVER f AS nf
              FROM filled_minute
              WINDOW b AS (PARTITION BY instrument, session_date ORDER BY slot
                           ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
                     f AS (PARTITION BY instrument, session_date ORDER BY slot
                           ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))
        WHERE nb = 30 AND nf = 15""",
)
def _(spark, sf_dir):
    c = fx.MINUTELY
    filled = interpolate_linear(fx.grid(spark, sf_dir, c), ["price"])
    return rolling_targets(filled, c.n_back, c.n_forward).select(
        *DAY_KEYS, n("slot"), single("x_mean"), r("x_std")
    )


@query("row_counts", "SELECT instrument, session_date, count(*) AS n FROM aligned_minute GROUP BY 1, 2")
def _(spark, sf_dir):
    return row_counts(fx.aligned(spark, sf_dir, "Minute"), *DAY_KEYS)


# --- data quality ---


@query(
    "nan_count",
    'SELECT count(*) FILTER (WHERE price IS NULL) AS "price_NaN_count" FROM grid_minute',
)
def _(spark, sf_dir):
    # Empty slots written as NaN, the array convention for missing.
    holes = fx.grid(spark, sf_dir, fx.MINUTELY).select(
        F.coalesce("price", F.lit(float("nan"))).alias("price")
    )
    return nan_count(holes, "price")


@query(
    "null_cells_total",
    """SELECT CAST(4 * count(*) FILTER (WHERE price IS NULL) AS BIGINT) AS null_cells FROM grid_minute""",
)
def _(spark, sf_dir):
    return null_cells_total(fx.grid(spark, sf_dir, fx.MINUTELY))


@query(
    "rows_with_any_null",
    "SELECT instrument, session_date, slot FROM grid_minute WHERE price IS NULL OR volume IS NULL",
)
def _(spark, sf_dir):
    return rows_with_any_null(fx.grid(spark, sf_dir, fx.MINUTELY)).select(*DAY_KEYS, n("slot"))


@query(
    "missing_profile",
    """SELECT 'slot' AS "column", count(*) - count(slot) AS nulls, CAST(0 AS BIGINT) AS nans FROM grid_minute
       UNION ALL SELECT 'price', count(*) - count(price), 0 FROM grid_minute
       UNION ALL SELECT 'volume', 0, count(*) - count(volume) FROM grid_minute""",
)
def _(spark, sf_dir):
    rows = fx.grid(spark, sf_dir, fx.MINUTELY).select(
        "slot", "price", F.coalesce(F.col("volume").cast("double"), F.lit(float("nan"))).alias("volume")
    )
    return missing_profile(rows)


# --- window and sequence operators ---


@query(
    "timestamp_diffs",
    """SELECT instrument, timestamp, CAST(trunc((timestamp - lag(timestamp) OVER (PARTITION BY instrument,
              session_date ORDER BY timestamp)) / 60.0) AS BIGINT) AS diff_timestamp FROM aligned_minute""",
)
def _(spark, sf_dir):
    return timestamp_diffs(fx.aligned(spark, sf_dir, "Minute"), 60).select(
        "instrument", "timestamp", n("diff_timestamp")
    )


@query(
    "slot_next",
    """SELECT instrument, session_date, slot, round(price, 6) AS price, volume, round(sine, 6) + 0.0 AS sine,
              round(cosine, 6) + 0.0 AS cosine FROM placed_minute""",
)
def _(spark, sf_dir):
    return fx.placed(spark, sf_dir, fx.MINUTELY).select(
        *DAY_KEYS, n("slot"), r("price"), n("volume"),
        (r("sine") + 0.0).alias("sine"), (r("cosine") + 0.0).alias("cosine"),
    )


@query(
    "slot_own",
    "SELECT instrument, session_date, slot, round(price, 6) AS price FROM placedown_minute",
)
def _(spark, sf_dir):
    signals = with_signals(fx.aligned(spark, sf_dir, "Minute"))
    return place_on_slots(signals, ["price"], 60, "own").select(*DAY_KEYS, n("slot"), r("price"))


@query(
    "trim_trailing",
    "SELECT instrument, session_date, slot, round(price, 6) AS price FROM grid_hour",
)
def _(spark, sf_dir):
    # A grid of a whole day and an hour leaves empty slots at the end.
    wide = regular_grid(fx.placed(spark, sf_dir), F.lit(24))
    return trim_trailing(wide, "price").select(*DAY_KEYS, n("slot"), r("price"))


@query(
    "interpolate_linear",
    """SELECT instrument, session_date, slot, round(price, 5) AS price, round(volume, 5) AS volume,
              round(sine, 6) + 0.0 AS sine, round(cosine, 6) + 0.0 AS cosine FROM filled_hour""",
)
def _(spark, sf_dir):
    return interpolate_linear(fx.grid(spark, sf_dir), SIGNALS).select(
        *DAY_KEYS, n("slot"), r("price", 5), r("volume", 5),
        (r("sine") + 0.0).alias("sine"), (r("cosine") + 0.0).alias("cosine"),
    )


@query(
    "day_signals",
    """SELECT instrument, session_date, count(*) AS n_slots, round(sum(price), 4) AS price,
              round(sum(volume), 4) AS volume, round(sum(sine), 5) + 0.0 AS sine,
              round(sum(cosine), 5) + 0.0 AS cosine
       FROM filled_minute GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    def total(v):
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    return fx.days(spark, sf_dir, fx.MINUTELY).select(
        *DAY_KEYS,
        F.size("price").cast("long").alias("n_slots"),
        r(total("price"), 4).alias("price"),
        r(total("volume"), 4).alias("volume"),
        (r(total("sine"), 5) + 0.0).alias("sine"),
        (r(total("cosine"), 5) + 0.0).alias("cosine"),
    )


@query(
    "lookback_windows",
    f"""SELECT {KEYS_SQL}, step, round(price, 5) AS price, round(volume, 5) AS volume FROM back_hour""",
)
def _(spark, sf_dir):
    return _windows(spark, sf_dir).select(
        *_sample_keys(), F.posexplode(F.arrays_zip("x_price", "x_volume")).alias("step", "_e")
    ).select(
        *SAMPLE, n("step"), r(F.col("_e.x_price"), 5).alias("price"), r(F.col("_e.x_volume"), 5).alias("volume")
    )


@query(
    "lookahead_minmax",
    f"SELECT {KEYS_SQL}, round(y_min, 5) AS y_min, round(y_max, 5) AS y_max FROM targets_hour",
)
def _(spark, sf_dir):
    return _windows(spark, sf_dir).select(*_sample_keys(), r("y_min", 5), r("y_max", 5))


@query("lookahead_path", f"SELECT {KEYS_SQL}, step, round(price, 5) AS price FROM ahead_hour")
def _(spark, sf_dir):
    return _windows(spark, sf_dir).select(
        *_sample_keys(), F.posexplode("y_path").alias("step", "price")
    ).select(*SAMPLE, n("step"), r("price", 5))


# --- scaling and assembly ---


def _zscore(name: str, array: str, short: str):
    @query(
        name,
        f"""SELECT {KEYS_SQL}, step, round(({short} - {short}_mean) / nullif({short}_std, 0), 5) + 0.0 AS z
            FROM back_hour JOIN moments_hour USING (instrument, session_date, sample_slot)""",
    )
    def _(spark, sf_dir):
        windows = with_moments(_windows(spark, sf_dir), {short: array})
        return zscore_window(windows, array, short).select(
            *_sample_keys(), F.posexplode(f"z_{short}").alias("step", "z")
        ).select(*SAMPLE, n("step"), (r("z", 5) + 0.0).alias("z"))


_zscore("zscore_price", "x_price", "price")
_zscore("zscore_volume", "x_volume", "volume")


@query(
    "scale_targets",
    f"""SELECT {KEYS_SQL}, round((y_min - price_mean) / nullif(price_std, 0), 5) + 0.0 AS y_min_scaled,
               round((y_max - price_mean) / nullif(price_std, 0), 5) + 0.0 AS y_max_scaled
        FROM targets_hour JOIN moments_hour USING (instrument, session_date, sample_slot)""",
)
def _(spark, sf_dir):
    scaled = scale_targets(with_moments(_windows(spark, sf_dir), {"price": "x_price"}))
    return scaled.select(
        *_sample_keys(),
        (r("y_min_scaled", 5) + 0.0).alias("y_min_scaled"),
        (r("y_max_scaled", 5) + 0.0).alias("y_max_scaled"),
    )


@query(
    "scale_path",
    f"""SELECT {KEYS_SQL}, step, round((price - price_mean) / nullif(price_std, 0), 5) + 0.0 AS y
        FROM ahead_hour JOIN moments_hour USING (instrument, session_date, sample_slot)""",
)
def _(spark, sf_dir):
    scaled = scale_path(with_moments(_windows(spark, sf_dir), {"price": "x_price"}))
    return scaled.select(*_sample_keys(), F.posexplode("y_path_scaled").alias("step", "y")).select(
        *SAMPLE, n("step"), (r("y", 5) + 0.0).alias("y")
    )


@query(
    "path_moments",
    f"""SELECT {KEYS_SQL}, CAST(CAST(path_mean AS FLOAT) AS DOUBLE) AS path_mean, round(path_std, 6) AS path_std
        FROM targets_hour""",
)
def _(spark, sf_dir):
    return with_moments(_windows(spark, sf_dir), {"path": "y_path"}).select(
        *_sample_keys(), single("path_mean"), r("path_std")
    )


@query(
    "unscale",
    f"""SELECT {KEYS_SQL}, CASE WHEN price_std > 0 THEN CAST(CAST(y_min AS FLOAT) AS DOUBLE) END AS y_min,
               CASE WHEN price_std > 0 THEN CAST(CAST(y_max AS FLOAT) AS DOUBLE) END AS y_max
        FROM targets_hour JOIN moments_hour USING (instrument, session_date, sample_slot)""",
)
def _(spark, sf_dir):
    scaled = scale_targets(with_moments(_windows(spark, sf_dir), {"price": "x_price"}))

    def back(c):
        return unscale(F.col(f"{c}_scaled"), F.col("price_mean"), F.col("price_std")).alias(c)

    restored = scaled.select(*SAMPLE, back("y_min"), back("y_max"))
    return restored.select(*_sample_keys(), single("y_min"), single("y_max"))


@query("extra_feature", f"SELECT {KEYS_SQL}, step, round(extra, 5) + 0.0 AS extra FROM back_hour")
def _(spark, sf_dir):
    return with_extra_feature(_windows(spark, sf_dir), one_step_change).select(
        *_sample_keys(), F.posexplode("x_extra").alias("step", "extra")
    ).select(*SAMPLE, n("step"), (r("extra", 5) + 0.0).alias("extra"))


@query("extra_feature_matrix", f"SELECT {KEYS_SQL}, step, round(extra, 5) + 0.0 AS extra FROM back_hour")
def _(spark, sf_dir):
    return with_extra_feature(_windows(spark, sf_dir), matrix_feature(step_changes)).select(
        *_sample_keys(), F.posexplode("x_extra").alias("step", "extra")
    ).select(*SAMPLE, n("step"), (r("extra", 5) + 0.0).alias("extra"))


@query(
    "feature_tensor",
    f"""SELECT {KEYS_SQL}, step, round((price - price_mean) / nullif(price_std, 0), 5) + 0.0 AS z_price,
               round((volume - volume_mean) / nullif(volume_std, 0), 5) + 0.0 AS z_volume,
               round((extra - extra_mean) / nullif(extra_std, 0), 5) + 0.0 AS z_extra,
               round(sine, 6) + 0.0 AS sine, round(cosine, 6) + 0.0 AS cosine
        FROM back_hour JOIN moments_hour USING (instrument, session_date, sample_slot)""",
)
def _(spark, sf_dir):
    samples = _prepared(spark, sf_dir).samples
    long = tensor_long(samples, *SAMPLE)
    return long.select(
        *_sample_keys(),
        n("step"),
        *((r(c, 5) + 0.0).alias(c) for c in ("z_price", "z_volume", "z_extra")),
        *((r(c) + 0.0).alias(c) for c in ("sine", "cosine")),
    )


@query(
    "sample_time",
    f"""SELECT {KEYS_SQL}, CAST(start + sample_slot * 3600 AS BIGINT) AS sample_epoch
        FROM samples_hour JOIN (SELECT instrument, session_date, min(timestamp) AS start FROM signals_hour
                                GROUP BY 1, 2) USING (instrument, session_date)""",
)
def _(spark, sf_dir):
    return _prepared(spark, sf_dir).samples.select(*_sample_keys(), "sample_epoch")


@query(
    "feature_vectors",
    f"""SELECT {KEYS_SQL}, step * 5 + c AS at, round(CASE c
               WHEN 0 THEN coalesce((price - price_mean) / nullif(price_std, 0), 0)
               WHEN 1 THEN coalesce((volume - volume_mean) / nullif(volume_std, 0), 0)
               WHEN 2 THEN coalesce((extra - extra_mean) / nullif(extra_std, 0), 0)
               WHEN 3 THEN sine ELSE cosine END, 5) + 0.0 AS feature
        FROM back_hour JOIN moments_hour USING (instrument, session_date, sample_slot), range(5) channel(c)""",
)
def _(spark, sf_dir):
    vectors = feature_vectors(_prepared(spark, sf_dir).samples)
    return vectors.select(
        *_sample_keys(), F.posexplode(vector_to_array("features")).alias("at", "feature")
    ).select(*SAMPLE, n("at"), (r("feature", 5) + 0.0).alias("feature"))


@query(
    "tensor_shape",
    "SELECT count(*) AS n_samples, CAST(6 AS BIGINT) AS n_timepoints, CAST(5 AS BIGINT) AS n_features FROM samples_hour",
)
def _(spark, sf_dir):
    shape = tensor_shape(_prepared(spark, sf_dir).samples)
    return shape.select("n_samples", n("n_timepoints"), n("n_features"))


@query("window_regression")
def _(spark, sf_dir):
    return window_regression(feature_vectors(_prepared(spark, sf_dir).samples))


# --- position, sampling, split ---


@query(
    "global_position",
    """SELECT instrument, timestamp, row_number() OVER (ORDER BY session_date, instrument, timestamp) - 1
       AS position FROM aligned_minute""",
)
def _(spark, sf_dir):
    rows = fx.aligned(spark, sf_dir, "Minute").select("instrument", "session_date", "timestamp")
    return global_position(rows, ["session_date", "instrument"], ["timestamp"]).select(
        "instrument", "timestamp", "position"
    )


SHUFFLED = """SELECT instrument, timestamp, row_number() OVER (ORDER BY
    md5(concat_ws('#', '54', instrument, CAST(timestamp AS VARCHAR))), instrument, timestamp) - 1 AS position
    FROM bars_minute"""


@query("seeded_shuffle", SHUFFLED)
def _(spark, sf_dir):
    rows = fx.bars(spark, sf_dir, "Minute").select("instrument", "timestamp")
    return seeded_shuffle(rows, 54, ["instrument", "timestamp"])


@query(
    "split_fractions",
    f"""SELECT instrument, timestamp, position, CASE WHEN position < a THEN 'train'
               WHEN position < a + b THEN 'val' WHEN position < a + 2 * b THEN 'test' END AS split
        FROM (SELECT *, floor(CAST(0.75 AS DOUBLE) * count(*) OVER ()) AS a,
                     floor(CAST(0.125 AS DOUBLE) * count(*) OVER ()) AS b FROM ({SHUFFLED}))""",
)
def _(spark, sf_dir):
    rows = fx.bars(spark, sf_dir, "Minute").select("instrument", "timestamp")
    placed = seeded_shuffle(rows, 54, ["instrument", "timestamp"])
    total = rows.agg(F.count("*")).scalar()
    return split_fractions(placed, fx.HOURLY.train_val_test_split, total)


@query(
    "tail_holdout",
    """SELECT instrument, timestamp, CASE WHEN position < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
              ELSE 'val' END AS split
       FROM (SELECT *, row_number() OVER (ORDER BY session_date, instrument, timestamp) - 1 AS position,
                    count(*) OVER () AS n FROM aligned_minute)""",
)
def _(spark, sf_dir):
    rows = fx.aligned(spark, sf_dir, "Minute").select("instrument", "session_date", "timestamp")
    placed = global_position(rows, ["session_date", "instrument"], ["timestamp"])
    return tail_holdout(placed, 0.2, rows.agg(F.count("*")).scalar()).select(
        "instrument", "timestamp", "split"
    )


@query(
    "time_ordered",
    """SELECT instrument, timestamp, datetime_tz FROM aligned_minute ORDER BY timestamp, instrument""",
)
def _(spark, sf_dir):
    return fx.aligned(spark, sf_dir, "Minute").select("instrument", "timestamp", "datetime_tz").orderBy(
        "timestamp", "instrument"
    )


@query(
    "first_row",
    """SELECT instrument, timestamp, round(lhc, 6) AS lhc FROM aligned_minute
       ORDER BY timestamp, instrument LIMIT 1""",
)
def _(spark, sf_dir):
    return fx.aligned(spark, sf_dir, "Minute").select("instrument", "timestamp", r("lhc")).orderBy(
        "timestamp", "instrument"
    ).limit(1)


@query(
    "reduced_split",
    f"""SELECT {KEYS_SQL}, CAST(position // 30 AS BIGINT) AS position,
               CASE WHEN position // 30 < a THEN 'train' WHEN position // 30 < a + b THEN 'val'
                    WHEN position // 30 < a + 2 * b THEN 'test' END AS split
        FROM (SELECT *, floor(CAST(0.75 AS DOUBLE) * ceil(total / 30.0)) AS a,
                     floor(CAST(0.125 AS DOUBLE) * ceil(total / 30.0)) AS b
              FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY md5(concat_ws('#', '54',
                           instrument, CAST(session_date AS VARCHAR), CAST(sample_slot AS VARCHAR)))) - 1
                           AS position FROM samples_minute))
        WHERE position % 30 = 0""",
)
def _(spark, sf_dir):
    done = prepare(fx.bars(spark, sf_dir, "Minute"), fx.shift_lookup(spark), fx.MINUTELY)
    return done.samples.select(*_sample_keys(), "position", "split")
