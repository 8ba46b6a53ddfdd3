import numpy as np
import pytest

from tsforge.operators.lags import iterated_difference, lag_difference, with_neighbours
from tsforge.operators.stats import (
    acf,
    choose_d,
    lag_differences,
    mse,
    pacf,
    significant_lags,
    significant_lags_to_end,
    unit_root,
    unit_root_augmented,
)


def series(spark, **named):
    rows = [(k, i, float(v)) for k, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s string, bin long, x double")


def ar1(n, slope, seed, start=0.0):
    rng = np.random.default_rng(seed)
    x = [start]
    for e in rng.normal(size=n - 1):
        x.append(slope * x[-1] + e)
    return np.array(x)


def brute_acf(x, k):
    c = x - x.mean()
    return (c[k:] * c[: len(c) - k]).sum() / (c * c).sum()


def dickey_fuller(x, lags, skip=None):
    """Statistic and AIC by ordinary least squares; skip is the number of leading changes left out."""
    dx = np.diff(x)
    skip = lags if skip is None else skip
    y = dx[skip:]
    columns = [np.ones(len(y)), x[skip:-1]] + [dx[skip - k : len(dx) - k] for k in range(1, lags + 1)]
    a = np.stack(columns, axis=1)
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rss = ((y - a @ beta) ** 2).sum()
    var = rss / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)
    return beta[1] / np.sqrt(var[1, 1]), len(y) * np.log(rss / len(y)) + 2 * a.shape[1], len(y)


@pytest.mark.parametrize("block", [4, 7, 1024])
def test_blocks_do_not_change_neighbours(spark, block):
    x = np.random.default_rng(0).random(30)
    df = series(spark, a=x, b=x[:9])
    out = with_neighbours(df, ["s"], {"m": ("x", -3), "p": ("x", 2)}, block=block).collect()
    assert len(out) == 39
    for r in out:
        v = x if r.s == "a" else x[:9]
        assert r.m == (v[r.bin - 3] if r.bin >= 3 else None)
        assert r.p == (v[r.bin + 2] if r.bin + 2 < len(v) else None)


def test_blocks_are_as_long_as_the_longest_offset(spark):
    x = [float(i) for i in range(20)]
    out = with_neighbours(series(spark, a=x), ["s"], {"m": ("x", -7), "p": ("x", 5)}, block=2).collect()
    assert sorted((r.bin, r.m, r.p) for r in out) == [
        (i, x[i - 7] if i >= 7 else None, x[i + 5] if i + 5 < 20 else None) for i in range(20)
    ]


def test_differences(spark):
    x = np.random.default_rng(1).random(20)
    df = series(spark, a=x)
    ahead = {r.bin: r.diff for r in lag_difference(df, ["s"], "x", 3).collect()}
    assert all(ahead[i] == (x[i] - x[i + 3] if i < 17 else None) for i in range(20))
    assert {r.diff for r in lag_difference(df, ["s"], "x", 0).collect()} == set(x)
    for r in iterated_difference(df, ["s"], "x", (0, 1, 2, 3)).dropna(subset=["diff"]).collect():
        assert r.diff == pytest.approx(np.diff(x, r.d)[r.bin - r.d])


def test_autocorrelations(spark):
    values = {"a": ar1(80, 0.7, 1), "b": ar1(50, -0.4, 2)}
    df = series(spark, **values)
    r = {(row.s, row.lag): row.acf for row in acf(df, ["s"], "x", 6).collect()}
    assert all(r[s, k] == pytest.approx(brute_acf(x, k)) for s, x in values.items() for k in range(7))
    for row in pacf(df, ["s"], "x", 6).collect():
        if row.lag == 0:
            assert row.pacf == 1.0
            continue
        rho = np.array([brute_acf(values[row.s], k) for k in range(row.lag + 1)])
        toeplitz = rho[np.abs(np.subtract.outer(np.arange(row.lag), np.arange(row.lag)))]
        assert row.pacf == pytest.approx(np.linalg.solve(toeplitz, rho[1:])[-1])


def test_significant_lags(spark):
    x = ar1(200, 0.8, 3)
    rho = np.array([brute_acf(x, k) for k in range(11)])
    band = [1.959963984540054 * np.sqrt((1 + 2 * (rho[1:k] ** 2).sum()) / 200) for k in range(1, 11)]
    inside = [k for k in range(1, 11) if abs(rho[k]) <= band[k - 1]]
    out = significant_lags(series(spark, a=x), ["s"], "x", 10).first()
    assert out.n_acf == (inside[0] - 1 if inside else 10)
    assert out.n_pacf == 1


def test_unit_root_matches_least_squares(spark):
    values = {"ar": ar1(120, 0.5, 4), "walk": ar1(120, 1.0, 5)}
    for r in unit_root(series(spark, **values), ["s"], "x").collect():
        stat, _, n = dickey_fuller(values[r.s], 0)
        assert r.stat == pytest.approx(stat) and r.n_obs == n
        assert r.crit_1 < r.crit_5 < r.crit_10
        assert (r.p_quantile <= -1.6448536269514722) == (r.s == "ar")


def test_augmented_test_chooses_lags_by_aic(spark):
    values = {"a": ar1(150, 0.9, 6), "b": np.cumsum(ar1(150, 0.6, 7))}
    df = series(spark, **values)
    for r in unit_root_augmented(df, ["s"], "x", 4).collect():
        x = values[r.s]
        best = int(np.argmin([dickey_fuller(x, k, 4)[1] for k in range(5)]))
        stat, _, n = dickey_fuller(x, best)
        assert (r.used_lag, r.n_obs) == (best, n) and r.stat == pytest.approx(stat, rel=1e-6)
    for r in unit_root_augmented(df, ["s"], "x", 2, choose=False).collect():
        assert r.stat == pytest.approx(dickey_fuller(values[r.s], 2)[0], rel=1e-6)


def test_choose_d(spark):
    walk = ar1(200, 1.0, 9)
    df = series(spark, still=ar1(200, 0.3, 8), walk=walk, trend=np.arange(200) ** 3.0)
    out = {r.s: r.d for r in choose_d(df, ["s"], "x", 2).collect()}
    assert out["still"] == 0 and out["walk"] == 1 and out["trend"] is None
    both = lag_differences(df.filter("s = 'walk'"), ["s"], "x", 1).filter("d = 1").orderBy("bin").collect()
    assert np.allclose([r.diff for r in both], walk[:-1] - walk[1:])
    assert {r.s: r.d for r in choose_d(df, ["s"], "x", 2, 3).collect()}["still"] == 0


def test_mse_skips_unknown(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, None)], "s string, x double, y double")
    assert mse(df, "x", "y", "s").first().mse == 4.0


def test_lags_are_searched_to_the_end_of_the_series(spark):
    values = {"slow": ar1(500, 0.97, 11), "fast": ar1(500, 0.3, 12), "flat": np.ones(50), "short": np.arange(4.0)}
    df = series(spark, **values)
    assert {r.s: r.n_acf for r in significant_lags(df, ["s"], "x", 10).collect()}["slow"] is None
    out = {r.s: r for r in significant_lags_to_end(df, ["s"], "x", 10).collect()}
    assert set(out) == set(values) and out["flat"].n_acf is None
    for s in ("slow", "fast"):
        rho = np.array([brute_acf(values[s], k) for k in range(200)])
        band = [1.959963984540054 * np.sqrt((1 + 2 * (rho[1:k] ** 2).sum()) / 500) for k in range(1, 200)]
        assert out[s].n_acf == next(k for k in range(1, 200) if abs(rho[k]) <= band[k - 1]) - 1
    assert out["slow"].n_acf > 10


def test_long_reach_has_a_flat_plan_and_plain_results(spark):
    from tsforge.operators.stats import acf_array, lag_products, levinson, pacf_array

    rnd = np.random.default_rng(3)
    groups = {"a": np.cumsum(rnd.normal(size=700)), "b": rnd.normal(size=40), "c": np.full(30, 2.0)}
    rows = [(g, t, float(x)) for g, w in groups.items() for t, x in enumerate(w)]
    series = spark.createDataFrame(rows, "g string, bin long, y double").repartition(3)
    size = {k: len(acf_array(series, ["g"], "y", k)._jdf.queryExecution().optimizedPlan().toString()) for k in (10, 600)}
    assert size[600] - size[10] < 50
    for block in (64, 8_192):
        sums = {r["g"]: r["products"] for r in lag_products(series, ["g"], "y", 50, block=block).collect()}
        for g, w in groups.items():
            plain = [float((w[k:] * w[: len(w) - k]).sum()) if k < len(w) else 0.0 for k in range(51)]
            assert np.allclose(sums[g], plain, atol=1e-8)
    got = {r["g"]: r for r in pacf_array(series, ["g"], "y", 600).collect()}
    x = groups["a"] - groups["a"].mean()
    r = np.array([float((x[k:] * x[: len(x) - k]).sum()) for k in range(601)]) / float((x * x).sum())
    assert np.allclose(got["a"]["acf"], r, atol=1e-9)
    assert np.allclose(got["a"]["pacf"], levinson(r), atol=1e-6)
    assert got["b"]["acf"][39] is not None and got["b"]["acf"][40] is None
    assert got["c"]["acf"][:2] == [1.0, None] and got["c"]["pacf"][1] is None
