import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsforge.operators.grid import (
    fill_series,
    interpolate_linear,
    length_consistent_days,
    place_on_slots,
    regular_grid,
    resample_mean,
    timestamp_diffs,
    timestamp_spine_join,
    trim_trailing,
)
from tsforge.operators.windows import SIGNALS, collect_day_signals, day_arrays, day_lengths, day_signals

DAY = dt.date(2024, 1, 2)
ROW = "instrument string, session_date date, timestamp long, price double"


def day(spark, epochs, values=None, name="a"):
    values = values or [float(i + 1) for i in range(len(epochs))]
    return spark.createDataFrame([(name, DAY, e, v) for e, v in zip(epochs, values)], ROW)


def slots(df):
    return {r.slot: r.price for r in df.collect()}


def test_diffs_truncate_toward_zero(spark):
    rows = timestamp_diffs(day(spark, [0, 59, 119, 300]), 60).orderBy("timestamp").collect()
    assert [r.diff_timestamp for r in rows] == [None, 0, 1, 3]


def test_next_rule_puts_values_at_the_end_of_their_gap(spark):
    assert slots(place_on_slots(day(spark, [0, 60, 240, 300]), ["price"], 60)) == {0: 1.0, 3: 2.0, 4: 3.0}


def test_own_rule_keeps_every_value(spark):
    placed = place_on_slots(day(spark, [0, 60, 240, 300]), ["price"], 60, "own")
    assert slots(placed) == {0: 1.0, 1: 2.0, 4: 3.0, 5: 4.0}


def test_first_gap_leads_with_the_first_value(spark):
    placed = place_on_slots(day(spark, [0, 180, 240, 300]), ["price"], 60)
    filled = interpolate_linear(regular_grid(placed), ["price"])
    assert slots(filled) == {0: 1.0, 1: 1.0, 2: 1.0, 3: 2.0, 4: 3.0}


def test_short_first_step_is_dropped_and_later_value_wins(spark):
    assert slots(place_on_slots(day(spark, [0, 30, 90, 150]), ["price"], 60)) == {0: 2.0, 1: 3.0}
    assert slots(place_on_slots(day(spark, [0, 60, 90, 150]), ["price"], 60)) == {0: 2.0, 1: 3.0}


def test_single_bar_has_no_slot_under_next(spark):
    assert place_on_slots(day(spark, [60]), ["price"], 60).count() == 0


def test_slots_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    epochs = np.cumsum(rng.integers(10, 400, 300)).tolist()
    values = rng.random(300).tolist()
    expected, at = {}, -1
    for i in range(len(epochs) - 1):
        at += int((epochs[i + 1] - epochs[i]) / 60)
        if at >= 0:
            expected[at] = values[i]
    assert slots(place_on_slots(day(spark, epochs, values), ["price"], 60)) == expected


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        place_on_slots(day(spark, [0, 60]), ["price"], 60, "other")


def test_interpolation_matches_numpy(spark):
    rng = np.random.default_rng(1)
    known = np.sort(rng.choice(200, 40, replace=False))
    values = rng.random(40)
    rows = spark.createDataFrame(
        [("a", DAY, i, float(dict(zip(known, values))[i]) if i in known else None) for i in range(200)],
        "instrument string, session_date date, slot int, price double",
    )
    out = slots(interpolate_linear(rows, ["price"]))
    expected = np.interp(np.arange(200), known, values)
    assert np.allclose([out[i] for i in range(200)], expected, atol=1e-12)
    series = rows.select("instrument", F.col("slot").alias("bin"), "price")
    blocked = {r.bin: r.price for r in fill_series(series, "price", ["instrument"], block=7).collect()}
    assert np.allclose([blocked[i] for i in range(200)], expected, atol=1e-12)


def test_trim_and_null_day_keys(spark):
    rows = spark.createDataFrame(
        [(None, DAY, 0, 1.0), (None, DAY, 2, 3.0)],
        "instrument string, session_date date, slot int, price double",
    )
    wide = regular_grid(rows, F.lit(6))
    assert wide.count() == 7
    assert slots(trim_trailing(wide, "price")) == {0: 1.0, 1: None, 2: 3.0}


def test_day_signals_equal_the_row_form(spark):
    rng = np.random.default_rng(5)
    rows = []
    for name in ("a", "b", None):
        for slot in np.sort(rng.choice(300, 60, replace=False)):
            rows.append((name, DAY, int(slot), *map(float, rng.random(4))))
    sparse = spark.createDataFrame(
        rows, "instrument string, session_date date, slot int, " + ", ".join(f"{s} double" for s in SIGNALS)
    )
    fused = {r.instrument: r for r in day_signals(sparse).collect()}
    plain = {r.instrument: r for r in collect_day_signals(interpolate_linear(regular_grid(sparse), SIGNALS)).collect()}
    assert fused.keys() == plain.keys()
    for name, row in plain.items():
        for s in SIGNALS:
            assert np.allclose(fused[name][s], row[s], atol=1e-12)


def test_inconsistent_days_go(spark):
    rows = spark.createDataFrame(
        [("a", DAY, 0, 1.0, 5), ("a", DAY, 60, 2.0, None), ("b", DAY, 0, 1.0, 5)],
        "instrument string, session_date date, timestamp long, lhc double, volume int",
    )
    kept = length_consistent_days(rows)
    assert [r.instrument for r in kept.collect()] == ["b"]
    arrays = day_arrays(kept).collect()
    assert arrays[0].price == [1.0] and arrays[0].volume == [5] and arrays[0].timestamp == [0]


def test_day_lengths(spark):
    rows = day(spark, [0, 60, 120]).unionByName(day(spark, [0], name="b"))
    out = {r.instrument: r for r in day_lengths(rows).collect()}
    assert out["a"].array_length == 3 and out["b"].array_length == 1
    assert {(r.min_array_length, r.max_array_length) for r in out.values()} == {(1, 4)}


def test_spine_join_adds_the_unmatched_null(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "timestamp long, v string")
    expected = rows.select("timestamp").distinct().join(rows, ["timestamp"], "outer")
    out = timestamp_spine_join(rows)
    key = lambda r: (r.timestamp is None, r.timestamp or 0, r.v or "")
    assert sorted(map(key, out.collect())) == sorted(map(key, expected.collect()))
    assert out.count() == 4


def test_missing_bins(spark):
    t = dt.datetime
    rows = spark.createDataFrame(
        [("s", t(2024, 1, 1, 3), 1.0), ("s", t(2024, 1, 1, 9), 3.0), ("s", t(2024, 1, 3), 5.0), (None, t(2024, 1, 5), 7.0)],
        "series string, Timestamp timestamp_ntz, price double",
    )
    out = resample_mean(rows, ["series"], 86400, block=2).orderBy("series", "bin").collect()
    assert [(r.series, r.bin, r.spot_price) for r in out] == [
        (None, 0, 7.0), ("s", 0, 2.0), ("s", 1, None), ("s", 2, 5.0)
    ]
    assert out[2].Timestamp == t(2024, 1, 2)


@pytest.mark.parametrize("width", [3600, 25200, 172800, 77])
def test_resample_matches_a_plain_loop(spark, width):
    rng = np.random.default_rng(width)
    start = dt.datetime(2024, 1, 1, 5, 30)
    moments = sorted(start + dt.timedelta(seconds=int(x)) for x in rng.integers(0, 4 * 86400 if width > 100 else 9000, 60))
    values = rng.random(60)
    rows = spark.createDataFrame(
        [("s", m, float(v)) for m, v in zip(moments, values)], "series string, Timestamp timestamp_ntz, price double"
    )
    midnight = dt.datetime(2024, 1, 1)
    if moments[0].date() != midnight.date():
        midnight = dt.datetime.combine(moments[0].date(), dt.time())
    sums = {}
    for m, v in zip(moments, values):
        sums.setdefault(int((m - midnight).total_seconds() // width), []).append(v)
    first, last = min(sums), max(sums)
    out = resample_mean(rows, ["series"], width, block=5).orderBy("bin").collect()
    assert [r.bin for r in out] == list(range(last - first + 1))
    for r in out:
        b = r.bin + first
        assert r.Timestamp == midnight + dt.timedelta(seconds=b * width)
        assert (r.spot_price is None) == (b not in sums)
        if b in sums:
            assert r.spot_price == pytest.approx(np.mean(sums[b]))
