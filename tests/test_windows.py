import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsforge.catalog.fixtures import shift_lookup
from tsforge.config import PrepConfig
from tsforge.functions.vectors import one_step_change, window_moments
from tsforge.operators.baseline import window_regression
from tsforge.operators.scaling import feature_vectors, unscale
from tsforge.operators.windows import lookback_windows, rolling_targets, with_lookahead_minmax
from tsforge.plans.candle_features import prepare, prepare_from_star
from tsforge.sources.candles import CandleStar

DAY = dt.date(2024, 1, 2)


def one_day(spark, signals):
    names = ("price", "volume", "sine", "cosine")
    columns = ", ".join(f"{n} array<double>" for n in names)
    return spark.createDataFrame(
        [("a", DAY, *(list(map(float, s)) for s in signals))], f"instrument string, session_date date, {columns}"
    )


@pytest.mark.parametrize("guard", [None, 0])
def test_windows_match_plain_slices(spark, guard):
    rng = np.random.default_rng(2)
    x = rng.random((4, 50))
    out = with_lookahead_minmax(lookback_windows(one_day(spark, x), 7, 3, guard)).orderBy("sample_slot").collect()
    last = 50 - (7 if guard is None else 0) - 3
    assert [r.sample_slot for r in out] == list(range(7, last))
    for r in out:
        i = r.sample_slot
        assert r.x_price == x[0, i - 7 : i].tolist() and r.x_cosine == x[3, i - 7 : i].tolist()
        assert r.y_path == x[0, i : i + 3].tolist()
        assert r.y_min == min(x[0, i : i + 3]) and r.y_max == max(x[0, i : i + 3])


@pytest.mark.parametrize("length", [1, 16, 17, 18])
def test_short_days_give_no_samples(spark, length):
    out = lookback_windows(one_day(spark, np.ones((4, length))), 7, 3)
    assert out.count() == max(0, length - 2 * 7 - 3)


def test_flat_window_has_exactly_no_deviation(spark):
    m = spark.range(1).select(window_moments(F.array_repeat(F.lit(37.21), 30)).alias("m")).first().m
    assert m.mean == 37.21 and m.std == 0.0


def test_row_form_moments_match_numpy(spark):
    x = np.random.default_rng(4).random(40)
    rows = spark.createDataFrame(
        [("a", DAY, i, float(v)) for i, v in enumerate(x)],
        "instrument string, session_date date, slot int, price double",
    )
    out = rolling_targets(rows, 6, 4).collect()
    assert sorted(r.slot for r in out) == list(range(6, 37))
    for r in out:
        back = x[r.slot - 6 : r.slot]
        assert r.x_mean == pytest.approx(back.mean()) and r.x_std == pytest.approx(back.std())
        assert r.y_max == max(x[r.slot : r.slot + 4])


def test_one_step_change(spark):
    out = spark.range(1).select(one_step_change(F.array(F.lit(1.0), F.lit(4.0), F.lit(2.0))).alias("x")).first().x
    assert out == [0.0, 3.0, -2.0]


def minute_bars(spark, days=4, seed=11):
    """Bars with gaps for two instruments, on days whose session ends before 17:00."""
    rng = np.random.default_rng(seed)
    rows = []
    for name in ("a", "b"):
        for d in range(days):
            start = int(dt.datetime(2024, 1, 8 + d, 14, tzinfo=dt.timezone.utc).timestamp())
            for m in np.flatnonzero(rng.random(90) < 0.6):
                price = round(float(rng.random()), 4)
                rows.append((name, start + 60 * int(m), price, price - 0.1, price + 0.2, price, int(rng.integers(1, 9))))
    return spark.createDataFrame(
        rows, "instrument string, timestamp long, o double, l double, h double, c double, volume int"
    )


CONFIG = PrepConfig(n_back=8, n_forward=4, shuffle_it=False, reduce_vector_sizes=False)


def expected_samples(bars, config):
    """The pipeline again as plain array code: {(instrument, date, slot): (tensor, y)}."""
    out = {}
    groups = {}
    for r in sorted(bars.collect(), key=lambda r: r.timestamp):
        date = dt.datetime.fromtimestamp(r.timestamp, dt.timezone.utc).date()
        groups.setdefault((r.instrument, date), []).append(r)
    for (name, date), rows in groups.items():
        t = np.array([r.timestamp for r in rows])
        end = np.cumsum((np.diff(t) / 60).astype(int)) - 1
        angle = 2 * np.pi * t / 86400
        raw = {
            "price": np.array([(r.l + r.h + r.c) / 3 for r in rows]),
            "volume": np.array([float(r.volume) for r in rows]),
            "sine": np.sqrt(2) * np.sin(angle),
            "cosine": np.sqrt(2) * np.cos(angle),
        }
        grid = np.arange(end[-1] + 1)
        x = {k: np.interp(grid, end, v[:-1]) for k, v in raw.items()}
        nb, nf = config.n_back, config.n_forward
        for i in range(nb, len(grid) - nb - nf):
            w = {k: v[i - nb : i] for k, v in x.items()}
            w["extra"] = np.diff(w["price"], prepend=w["price"][0])
            z = {k: (w[k] - w[k].mean()) / w[k].std() for k in ("price", "volume", "extra")}
            ahead = (x["price"][i : i + nf] - w["price"].mean()) / w["price"].std()
            tensor = np.stack([z["price"], z["volume"], z["extra"], w["sine"], w["cosine"]], axis=1)
            out[name, date, i] = tensor, (ahead.min(), ahead.max()), ahead
    return out


def test_pipeline_matches_plain_arrays(spark):
    bars = minute_bars(spark)
    expected = expected_samples(bars, CONFIG)
    rows = prepare(bars, shift_lookup(spark), CONFIG).samples.collect()
    assert {(r.instrument, r.session_date, r.sample_slot) for r in rows} == set(expected)
    for r in rows:
        tensor, (low, high), path = expected[r.instrument, r.session_date, r.sample_slot]
        got = np.array([list(s) for s in r.tensor], dtype=float)
        assert np.allclose(got, tensor, atol=1e-8)
        assert (r.y_min_scaled, r.y_max_scaled) == (pytest.approx(low), pytest.approx(high))
        assert np.allclose(r.y_path_scaled, path)
        assert r.y_min_scaled * r.price_std + r.price_mean == pytest.approx(r.y_min)
    in_order = sorted(rows, key=lambda r: r.position)
    assert [r.position for r in in_order] == list(range(len(rows)))
    assert [(r.session_date, r.instrument, r.sample_slot) for r in in_order] == sorted(
        (d, n, i) for n, d, i in expected
    )
    counts = {g: sum(r.split == g for r in rows) for g in ("train", "val", "test")}
    assert counts == {g: int(f * len(rows)) for g, f in CONFIG.train_val_test_split.items()}


def test_reduction_keeps_every_kth_of_the_shuffle_for_any_partitioning(spark):
    bars = minute_bars(spark)
    shuffled = replace(CONFIG, shuffle_it=True)
    everything = {
        (r.instrument, r.session_date, r.sample_slot): r.position
        for r in prepare(bars, shift_lookup(spark), shuffled).samples.collect()
    }
    assert sorted(everything.values()) == list(range(len(everything)))
    expected = {k: p // 5 for k, p in everything.items() if p % 5 == 0}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        reduced = replace(shuffled, reduce_vector_sizes=True, modulus_integer=5)
        rows = prepare(bars.repartition(int(n)), shift_lookup(spark), reduced).samples.select(
            "instrument", "session_date", "sample_slot", "position"
        ).collect()
        assert {(r.instrument, r.session_date, r.sample_slot): r.position for r in rows} == expected
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_flat_prices_give_null_scores_and_zero_features(spark):
    start = int(dt.datetime(2024, 1, 8, 14, tzinfo=dt.timezone.utc).timestamp())
    bars = spark.createDataFrame(
        [("a", start + 60 * m, 0.3, 0.3, 0.3, 0.3, 1) for m in range(40)],
        "instrument string, timestamp long, o double, l double, h double, c double, volume int",
    )
    rows = prepare(bars, shift_lookup(spark), CONFIG).samples
    first = rows.first()
    assert first.tensor[0].z_price is None and first.y_min_scaled is None
    assert feature_vectors(rows).first().features.size == 8 * 5


def test_unscale_undoes(spark):
    out = spark.range(1).select(unscale(F.lit(2.0), F.lit(10.0), F.lit(3.0)).alias("x")).first().x
    assert out == 16.0


def test_baseline_reports_every_target_and_split(spark):
    rows = prepare(minute_bars(spark), shift_lookup(spark), replace(CONFIG, shuffle_it=True)).samples
    report = window_regression(feature_vectors(rows), max_iter=10).collect()
    assert {(r.target, r.split) for r in report} == {
        (t, s) for t in ("y_min_scaled", "y_max_scaled") for s in ("train", "val", "test")
    }
    assert all(r.mse > 0 for r in report)


def test_star_pipeline_needs_an_instrument(spark):
    with pytest.raises(ValueError):
        prepare_from_star(CandleStar(*[spark.range(1)] * 6), shift_lookup(spark), PrepConfig())
