"""ARIMA fits by their own errors against sequential recursions."""

import numpy as np
import pytest

from tsforge.operators import css
from tsforge.operators.arima import arima_fit, forecast, innovations, order_grid


def simulated(rnd, n, c, phi, theta):
    e = rnd.normal(size=n + 100)
    w = np.zeros(n + 100)
    for t in range(n + 100):
        past = sum(a * w[t - 1 - i] for i, a in enumerate(phi) if t > i)
        shocks = sum(b * e[t - 1 - k] for k, b in enumerate(theta) if t > k)
        w[t] = c + past + shocks + e[t]
    return w[100:]


def sequential(z, c, phi, theta):
    """Errors one by one; values and errors before the first are 0."""
    e = np.zeros(len(z))
    for t in range(len(z)):
        past = sum(a * z[t - 1 - i] for i, a in enumerate(phi) if t > i)
        shocks = sum(b * e[t - 1 - k] for k, b in enumerate(theta) if t > k)
        e[t] = z[t] - c - past - shocks
    return e


@pytest.mark.parametrize("length", [1, 7, 100, 5_000])
def test_filter_equals_a_loop(length):
    rnd = np.random.default_rng(1)
    feedback = -css.from_partials(rnd.uniform(-0.95, 0.95, (4, 6)))
    x, start = rnd.normal(size=(4, 733)), rnd.normal(size=(4, 6))
    got = css.filtered(feedback, x, start, length)
    for i in range(4):
        y = list(start[i, ::-1])
        for t in range(733):
            y.append(x[i, t] - sum(feedback[i, k] * y[-1 - k] for k in range(6)))
        assert np.allclose(got[i], y, rtol=0, atol=1e-9)


def test_block_maps_compose():
    rnd = np.random.default_rng(2)
    feedback = -css.from_partials(rnd.uniform(-0.9, 0.9, (3, 4)))
    start = rnd.normal(size=(3, 4))
    y = css.filtered(feedback, np.zeros((3, 50)), start)
    assert np.allclose(np.einsum("mij,mj->mi", css.block_map(feedback, 50), start), y[:, :-5:-1], atol=1e-12)


def test_partials_and_coefficients_are_inverse():
    r = np.random.default_rng(3).uniform(-0.9, 0.9, (50, 5))
    order = np.arange(50) % 6
    r[np.arange(5) >= order[:, None]] = 0.0
    phi = css.from_partials(r)
    assert np.allclose(css.to_partials(phi, order), r)
    for row, p in zip(phi, order):
        roots = np.roots(np.concatenate((-row[:p][::-1], [1.0])))
        assert (np.abs(roots) > 1.0).all()


def test_errors_and_slopes_of_cut_series():
    rnd = np.random.default_rng(4)
    z = rnd.normal(size=400)
    models = css.Models([2, 0, 3, 0], [1, 3, 0, 0], [True, False, True, True])
    models.trial = rnd.normal(size=(4, models.k)) * models.used
    coefficients = models.coefficients(models.trial)
    e, slopes = models.errors(z, coefficients)
    for i in range(4):
        c, phi, theta = coefficients[i, 0], coefficients[i, 1 : 1 + models.np_], coefficients[i, 1 + models.np_ :]
        assert np.allclose(e[i], sequential(z, c, phi, theta), atol=1e-9)
        for j in np.flatnonzero(models.used[i]):
            up, down = coefficients[i].copy(), coefficients[i].copy()
            up[j] += 1e-6
            down[j] -= 1e-6
            numeric = [sequential(z, x[0], x[1 : 1 + models.np_], x[1 + models.np_ :]) for x in (up, down)]
            assert np.allclose(slopes[i, j], (numeric[0] - numeric[1]) / 2e-6, atol=1e-5)


def series_of(spark, groups):
    rows = [(g, t, float(x)) for g, w in groups.items() for t, x in enumerate(w)]
    return spark.createDataFrame(rows, "g string, bin long, y double").repartition(3)


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = np.random.default_rng(5)
    groups = {
        "ma": simulated(rnd, 600, 5.0, [], [0.88]),
        "arma": 10 + np.cumsum(simulated(rnd, 500, 0.0, [0.6], [0.4, 0.3])),
        "short": rnd.normal(size=12),
        "flat": np.full(200, 3.0),
    }
    series = series_of(spark, groups)
    innov = innovations(series, ["g"], "y", (0, 1, 2)).checkpoint()
    starts = arima_fit(innov, order_grid(innov, ["g"], 3), ["g"], 3).checkpoint()
    return groups, innov, starts, css.css_fit(innov, starts, ["g"]).checkpoint()


def scaled(w, d):
    w = np.diff(w, d)
    return (w - w.mean()) / w.std() if d == 0 else w / np.sqrt((w * w).mean())


def test_fits_are_minima_of_their_own_errors(fitted):
    groups, _, starts, fits = fitted
    before = {(r["g"], r["p"], r["d"], r["q"]): r for r in starts.collect()}
    rows = fits.collect()
    assert sorted(before) == sorted((r["g"], r["p"], r["d"], r["q"]) for r in rows)
    seen = 0
    for r in rows:
        old = before[r["g"], r["p"], r["d"], r["q"]]
        if old["mse"] is None:
            assert r["mse"] is None
            continue
        w = np.diff(groups[r["g"]], r["d"])
        std = w.std() if r["d"] == 0 else np.sqrt((w * w).mean())
        mean = w.mean() if r["d"] == 0 else 0.0
        z, n = scaled(groups[r["g"]], r["d"]), r["n_obs"]
        assert n == old["n_obs"]

        def mse(intercept, ar, ma):
            c = (intercept - mean * (1.0 - sum(ar))) / std
            e = sequential(z, c, ar, ma)[-n:]
            return float((e * e).mean()) * std * std

        if r["mse"] is None:
            continue
        seen += 1
        assert r["mse"] == pytest.approx(mse(r["intercept"], r["ar"], r["ma"]), rel=1e-8)
        for part, sign in ((r["ar"], -1.0), (r["ma"], 1.0)):
            if part:
                assert (np.abs(np.roots([*(sign * np.array(part))[::-1], 1.0])) > 1.0).all()
        # Not above the error of the start, where that is a model.
        if not old["ma"] or (np.abs(np.roots([*np.array(old["ma"])[::-1], 1.0])) > 1.05).all():
            if not old["ar"] or (np.abs(np.roots([*(-np.array(old["ar"]))[::-1], 1.0])) > 1.05).all():
                assert r["mse"] <= mse(old["intercept"], old["ar"], old["ma"]) * (1 + 1e-9)
        # No small step aside is better, unless the bound is in the way.
        parts = [css.to_partials(sign * np.array([x]), np.array([len(x)])) for x, sign in ((r["ar"], 1.0), (r["ma"], -1.0)) if x]
        if any(np.abs(x).max() > 0.96 for x in parts):
            continue
        for i in range(len(r["ar"]) + len(r["ma"])):
            for h in (1e-4, -1e-4):
                ar, ma = list(r["ar"]), list(r["ma"])
                (ar if i < len(ar) else ma)[i if i < len(ar) else i - len(ar)] += h
                if all((np.abs(np.roots([*(s * np.array(x))[::-1], 1.0])) > 1.01).all() for x, s in ((ar, -1.0), (ma, 1.0)) if x):
                    assert mse(r["intercept"], ar, ma) >= r["mse"] * (1 - 1e-7)
    assert seen > 50


def test_the_true_order_is_found_again(fitted):
    rows = {(r["g"], r["p"], r["d"], r["q"]): r for r in fitted[3].collect()}
    assert rows["ma", 0, 0, 1]["ma"][0] == pytest.approx(0.88, abs=0.05)
    assert rows["arma", 1, 1, 2]["ar"][0] == pytest.approx(0.6, abs=0.15)


@pytest.mark.parametrize("block", [150])
def test_series_of_many_blocks(spark, fitted, block):
    """Cut into blocks, the same minima and the same errors."""
    groups, innov, starts, fits = fitted
    some = starts.filter("g = 'ma' and d = 0 and p = 0 and q = 1 or g = 'arma' and d = 1 and p = 1 and q = 0 or g = 'flat' and d = 0 and p = 1 and q = 0")
    cut = {(r["g"], r["p"], r["d"], r["q"]): r for r in css.css_fit(innov, some, ["g"], block=block, max_steps=9).collect()}
    whole = {(r["g"], r["p"], r["d"], r["q"]): r for r in fits.collect()}
    assert len(cut) == some.count()
    for at, r in cut.items():
        assert (r["mse"] is None) == (whole[at]["mse"] is None)
        if r["mse"] is not None:
            assert r["mse"] == pytest.approx(whole[at]["mse"], rel=1e-7)
    chosen = fits.filter("g = 'arma' and p = 1 and d = 1 and q = 2 or g = 'ma' and p = 0 and d = 0 and q = 1")
    errors = css.own_errors(innov, chosen, ["g"], block=block)
    got = {}
    for r in errors.collect():
        got.setdefault((r["g"], r["d"]), {})[r["bin"]] = r["e"]
    for r in chosen.collect():
        w = np.diff(groups[r["g"]], r["d"])
        mean, std = (w.mean(), w.std()) if r["d"] == 0 else (0.0, np.sqrt((w * w).mean()))
        c = (r["intercept"] - mean * (1.0 - sum(r["ar"]))) / std
        expected = sequential((w - mean) / std, c, r["ar"], r["ma"])
        mine = [got[r["g"], r["d"]][t + r["d"]] for t in range(len(w))]
        assert np.allclose(mine, expected, atol=1e-9)


def test_fitted_values_and_forecasts_follow_the_model(spark, fitted):
    groups, innov, _, fits = fitted
    chosen = fits.filter("g = 'arma' and p = 1 and d = 1 and q = 2")
    r = chosen.first()
    y = groups["arma"]
    w = np.diff(y)
    e = sequential(w, r["intercept"], r["ar"], r["ma"])
    inside = {x["bin"]: x["fitted"] for x in css.own_fitted(innov, chosen, ["g"], "y", block=128).collect()}
    assert set(inside) == set(range(2, 500))
    assert all(inside[t] == pytest.approx(y[t] - e[t - 1], abs=1e-8) for t in inside)
    horizon = spark.createDataFrame([("arma", 4)], "g string, h int")
    own = css.with_own_errors(innov, chosen, ["g"])
    assert own.count() == innov.count()
    ahead = [x["forecast"] for x in forecast(own, chosen, ["g"], horizon, 3).orderBy("step").collect()]
    past, shocks, level, expected = list(w), list(e), y[-1], []
    for _ in range(4):
        step = r["intercept"] + r["ar"][0] * past[-1] + r["ma"][0] * shocks[-1] + r["ma"][1] * shocks[-2]
        past.append(step)
        shocks.append(0.0)
        level += step
        expected.append(level)
    assert ahead == pytest.approx(expected, rel=1e-9)


def test_no_rows(spark, fitted):
    _, innov, starts, _ = fitted
    assert css.css_fit(innov, starts.limit(0), ["g"]).count() == 0
    assert css.own_errors(innov, starts.limit(0), ["g"]).count() == 0
