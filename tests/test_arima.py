import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_stats import ar1, series
from tsforge.config import SpotConfig
from tsforge.operators.arima import (
    ar1_fit,
    ar1_fitted,
    ar1_forecast,
    arima_fit,
    arima_grid_fit,
    best_order,
    fitted_values,
    forecast,
    information_criteria,
    innovations,
    order_grid,
)
from tsforge.plans import spot_forecast

LONG = 10


def regress(y, columns, constant=True):
    """Coefficients with the constant first (0 where the model has none), and the residual sum."""
    a = np.stack([np.ones(len(y)) * constant, *columns], axis=1)
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    return beta, ((y - a @ beta) ** 2).sum()


def two_step(x, p, d, q, reach):
    """Coefficients, residual sum and sample size of the two-step regression, with its residuals."""
    w = np.diff(x, d)
    n = len(w)
    beta, _ = regress(w[LONG:], [w[LONG - k : n - k] for k in range(1, LONG + 1)], d == 0)
    e = np.full(n, np.nan)
    e[LONG:] = w[LONG:] - beta[0] - sum(beta[k] * w[LONG - k : n - k] for k in range(1, LONG + 1))
    start = LONG + reach - 1
    columns = [w[start - k : n - k] for k in range(1, p + 1)] + [e[start - k : n - k] for k in range(1, q + 1)]
    beta, rss = regress(w[start:], columns, d == 0)
    return beta, rss, n - start, w, e


@pytest.fixture(scope="module")
def fitted(spark):
    values = {"a": 40 + ar1(160, 0.6, 1), "b": np.cumsum(ar1(140, 0.4, 2))}
    df = series(spark, **values)
    innov = innovations(df, ["s"], "x", range(3)).cache()
    return values, df, innov, arima_grid_fit(innov, ["s"], 3)


def test_grid_matches_least_squares(spark, fitted):
    values, _, _, fits = fitted
    rows = fits.collect()
    assert len(rows) == 2 * 27
    for r in rows:
        beta, rss, n, _, _ = two_step(values[r.s], r.p, r.d, r.q, 3)
        assert r.n_obs == n and r.rss == pytest.approx(rss, rel=1e-6) and r.mse == pytest.approx(rss / n, rel=1e-6)
        assert [r.intercept, *r.ar, *r.ma] == pytest.approx(list(beta), rel=1e-5, abs=1e-7)


def test_fitted_and_forecast_match_the_recursion(spark, fitted):
    values, _, innov, fits = fitted
    for order in ((1, 0, 1), (2, 1, 0), (0, 2, 2), (0, 0, 0)):
        p, d, q = order
        chosen = fits.filter(f"p = {p} and d = {d} and q = {q}")
        got = {(r.s, r.bin): r.fitted for r in fitted_values(innov, chosen, ["s"], "x", 3).collect()}
        horizon = spark.createDataFrame([("a", 4), ("b", 6)], "s string, h long")
        ahead = {}
        for r in forecast(innov, chosen, ["s"], horizon, 3).collect():
            ahead.setdefault(r.s, {})[r.step] = (r.bin, r.forecast)
        for s, x in values.items():
            beta, _, _, w, e = two_step(x, p, d, q, 3)
            i = len(w) - 3
            one = beta[0] + sum(beta[k] * w[i - k] for k in range(1, p + 1)) + sum(
                beta[p + k] * e[i - k] for k in range(1, q + 1)
            )
            assert got[s, i + d] == pytest.approx(x[i + d] - w[i] + one, rel=1e-6)
            past, shocks, path = list(w), list(e), []
            for _ in range(4 if s == "a" else 6):
                new = beta[0] + sum(beta[k] * past[-k] for k in range(1, p + 1)) + sum(
                    beta[p + k] * shocks[-k] for k in range(1, q + 1)
                )
                past.append(new)
                shocks.append(0.0)
                path.append(new)
            for level in range(d - 1, -1, -1):
                path = np.diff(x, level)[-1] + np.cumsum(path)
            assert [ahead[s][k + 1][1] for k in range(len(path))] == pytest.approx(list(path), rel=1e-6)
            assert ahead[s][1][0] == len(x)


def test_singular_series_has_null_error(spark):
    df = series(spark, flat=[1.0] * 60, short=[1.0, 2.0, 1.5], long=list(ar1(60, 0.5, 1)))
    fits = arima_grid_fit(innovations(df, ["s"], "x", range(2)), ["s"], 2)
    rows = fits.collect()
    assert len(rows) == 3 * 8
    assert all((r.mse is None) == (r.s != "long") for r in rows)
    best = {r.s: r for r in best_order(fits, ["s"]).collect()}
    assert set(best) == {"flat", "short", "long"}
    assert best["flat"].mse is None and best["short"].p is None and best["long"].mse is not None


def test_best_order_takes_the_first_of_a_tie(spark):
    fits = spark.createDataFrame(
        [("a", 1, 0, 2, 5.0), ("a", 1, 0, 1, 5.0), ("a", 2, 0, 0, 5.0), ("a", 0, 0, 0, None)],
        "s string, p int, d int, q int, mse double",
    )
    out = best_order(fits, ["s"]).first()
    assert (out.p, out.d, out.q) == (1, 0, 1)


def test_order_grid(spark):
    df = series(spark, a=[1.0], b=[1.0])
    assert order_grid(df, ["s"], 6).distinct().count() == 2 * 216


def test_ar1_and_its_forecast(spark):
    values = {"a": 5 + ar1(100, 0.5, 3), "b": ar1(90, 1.0, 4)}
    df = series(spark, **values)
    fits = ar1_fit(df, ["s"], "x", (0, 1))
    found = {(r.s, r.d): r for r in fits.collect()}
    ahead = {}
    for r in ar1_forecast(df, fits, ["s"], "x", spark.createDataFrame([("a", 5), ("b", 3)], "s string, h int")).collect():
        ahead[r.s, r.d, r.step] = r.forecast
    for (s, d), r in found.items():
        w = np.diff(values[s], d)
        beta, rss = regress(w[1:], [w[:-1]], d == 0)
        assert (r.intercept, r.slope, r.rss) == (pytest.approx(beta[0]), pytest.approx(beta[1]), pytest.approx(rss))
        assert r.mse == pytest.approx(rss / (len(w) - 1))
        path, last = [], w[-1]
        for _ in range(5 if s == "a" else 3):
            last = beta[0] + beta[1] * last
            path.append(last)
        if d:
            path = values[s][-1] + np.cumsum(path)
        assert [ahead[s, d, k + 1] for k in range(len(path))] == pytest.approx(list(path))
    errors = ar1_fitted(df, fits, ["s"], "x", (0, 1)).groupBy("s", "d").agg(
        F.avg((F.col("x") - F.col("fitted")) ** 2).alias("m")
    ).collect()
    assert all(r.m == pytest.approx(found[r.s, r.d].mse) for r in errors)


def test_slope_of_one_gives_a_line(spark):
    df = series(spark, a=[1.0, 2.0, 4.0])
    fits = spark.createDataFrame([("a", 0, 0.5, 1.0), ("a", 1, 0.5, 1.0)], "s string, d int, intercept double, slope double")
    out = {(r.d, r.step): r.forecast for r in ar1_forecast(df, fits, ["s"], "x", spark.createDataFrame([("a", 2)], "s string, h int")).collect()}
    assert out == {(0, 1): 4.5, (0, 2): 5.0, (1, 1): 6.5, (1, 2): 9.5}


def test_information_criteria(spark):
    fits = spark.createDataFrame([(100, 50.0)], "n_obs long, rss double")
    out = information_criteria(fits, F.lit(3)).first()
    assert out.aic == pytest.approx(100 * np.log(0.5) + 6) and out.bic == pytest.approx(100 * np.log(0.5) + 3 * np.log(100))


def test_whole_comparison(spark):
    rng = np.random.default_rng(12)
    rows = []
    for name, slope in (("a", 0.6), ("b", 1.0)):
        for i, v in enumerate(50 + ar1(120, slope, 20)):
            if rng.random() < 0.9 or i in (0, 119):
                stamp = dt.datetime(2024, 1, 1) + dt.timedelta(days=i, hours=int(rng.integers(0, 24)))
                rows += [(name, stamp, f"{v:.4f}")] * 2
    records = spark.createDataFrame(rows, "s string, Timestamp timestamp_ntz, SpotPrice string")
    config = SpotConfig(n_grid=3, max_difference=2, max_lag=4)
    out = spot_forecast.run(records, ["s"], config)
    table = out.comparison.collect()
    assert len(table) == 240
    train = [r for r in table if r.split == "train"]
    test = [r for r in table if r.split == "test"]
    assert len(train) == 216 and len(test) == 24
    assert all(r.fit_best is None and r.forecast_best is not None for r in test)
    assert all(r.forecast_best is None for r in train)
    best = {r.s: r for r in out.best.collect()}
    assert set(best) == {"a", "b"} and all(r.aic < r.bic for r in best.values())
    assert {r.model for r in out.errors.collect()} >= {"best"}
    fit = arima_fit(
        innovations(out.split.filter("split = 'train'").select("s", "bin", "spot_price"), ["s"], "spot_price", range(3)),
        out.best.select("s", "p", "d", "q"), ["s"], 5, first=10 + 5 - 1 + 2,
    ).collect()
    # Both models are fitted on the same rows, so that their criteria can be compared.
    visual = {r.s: r for r in out.visual.collect()}
    assert set(visual) == {"a", "b"}
    assert all(r.n_obs in (None, best[r.s].n_obs) for r in visual.values())
    assert len({r.n_obs for r in best.values()}) == 1
    assert all(r.mse == pytest.approx(best[r.s].mse) for r in fit)


def test_slow_series_has_a_visual_model(spark):
    """Orders beyond max_lag are found, fitted and forecast; other series do not depend on that."""
    values = {"slow": 50 + ar1(240, 0.97, 31), "fast": 50 + ar1(240, 0.3, 32)}
    day = dt.datetime(2024, 1, 1)
    rows = [(s, day + dt.timedelta(days=i), f"{v:.4f}") for s, x in values.items() for i, v in enumerate(x)]
    records = spark.createDataFrame(rows, "s string, Timestamp timestamp_ntz, SpotPrice string")
    out = spot_forecast.run(records, ["s"], SpotConfig(n_grid=3, max_difference=1, max_lag=4))
    visual, best = ({r.s: r for r in fits.collect()} for fits in (out.visual, out.best))
    assert visual["slow"].p > 4 and visual["slow"].mse is not None and len(visual["slow"].ar) == visual["slow"].p
    assert all(visual[s].n_obs == best[s].n_obs for s in values)
    assert best["fast"].n_obs == 216 - (10 + 5 - 1 + 2)
    errors = {(r.s, r.model): r.mse for r in out.errors.collect()}
    assert errors["slow", "visual"] is not None and errors["fast", "visual"] is not None
