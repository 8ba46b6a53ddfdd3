"""Autoregressive and ARIMA models for many regular series at once.

Models are fitted by conditional least squares: AR(1) directly, ARIMA orders by the two-step
regression of Hannan and Rissanen (1982). Estimates differ slightly from exact maximum likelihood,
and the first rows, which lack lags, are not part of the error. Rows are handled by DataFrame
expressions; only moment matrices, one small row per series and differencing order, reach Python.

A model has a constant for d = 0 and none for d >= 1, where a constant would be a drift; moments are then taken about
zero. Every series keeps its row in every result: where a fit is not possible (series too short, constant, or without
an order), the results are NULL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsforge.functions.vectors import dot
from tsforge.operators.keys import join_on
from tsforge.operators.lags import iterated_difference, with_neighbours
from tsforge.operators.stats import cross_moments, square_matrices

# A moment matrix worse conditioned than this counts as singular.
MAX_CONDITION = 1e12


def order_grid(series: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Every (p, d, q) with each of 0..n-1, for every series."""
    orders = F.array(*(F.lit(i) for i in range(n)))
    return (
        series.select(*keys)
        .distinct()
        .withColumn("p", F.explode(orders))
        .withColumn("d", F.explode(orders))
        .withColumn("q", F.explode(orders))
    )


def differenced(
    series: DataFrame, keys: Sequence[str], value: str, orders: Sequence[int], position: str = "bin"
) -> DataFrame:
    """Long form of the d-fold differences without the leading rows that have none."""
    columns = [*keys, position, value]
    return iterated_difference(series.select(*columns), keys, value, orders, position).dropna(
        subset=["diff"]
    )


# --- AR(1) ---------------------------------------------------------------------------------------


def ar1_fit(
    series: DataFrame, keys: Sequence[str], value: str, orders: Sequence[int] = (0,), position: str = "bin"
) -> DataFrame:
    """AR(1) on the d-fold difference, for every series and d; with a constant for d = 0 only."""
    rows = differenced(series, keys, value, orders, position)
    by = [*keys, "d"]
    near = with_neighbours(rows, by, {"_before": ("diff", -1)}, position).filter("_before is not null")
    y, x, plain = F.col("diff"), F.col("_before"), F.col("d") == 0
    sums = near.groupBy(*by).agg(
        F.count("*").alias("n_obs"),
        F.regr_intercept(y, x).alias("_c"),
        F.regr_slope(y, x).alias("_b"),
        (F.regr_syy(y, x) - F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x))).alias("_rss"),
        *(F.sum(a * b).alias(n) for a, b, n in ((y, y, "_yy"), (x, y, "_xy"), (x, x, "_xx"))),
    )
    through_zero = F.col("_yy") - F.try_divide(F.col("_xy") * F.col("_xy"), F.col("_xx"))
    fits = sums.select(
        *by,
        "n_obs",
        F.when(plain, F.col("_c")).otherwise(F.lit(0.0)).alias("intercept"),
        F.when(plain, F.col("_b")).otherwise(F.try_divide("_xy", "_xx")).alias("slope"),
        F.when(plain, F.col("_rss")).otherwise(through_zero).alias("rss"),
    )
    every = series.select(*keys).distinct().withColumn("d", F.explode(F.array(*(F.lit(d) for d in orders))))
    used = F.when(plain, 2).otherwise(1)
    return join_on(every, fits, by, "left").withColumns({
        "mse": F.try_divide("rss", "n_obs"),
        "residual_variance": F.try_divide(F.col("rss"), F.col("n_obs") - used),
    })


def ar1_fitted(
    series: DataFrame, fits: DataFrame, keys: Sequence[str], value: str, orders: Sequence[int],
    position: str = "bin",
) -> DataFrame:
    """In-sample one-step predictions of every AR(1) fit, in units of the series."""
    rows = differenced(series, keys, value, orders, position)
    by = [*keys, "d"]
    near = with_neighbours(rows, by, {"_before": ("diff", -1)}, position).filter("_before is not null")
    residual = F.col("diff") - (F.col("intercept") + F.col("slope") * F.col("_before"))
    return join_on(near, fits.select(*by, "intercept", "slope"), by).select(
        *by, position, value, (F.col(value) - residual).alias("fitted")
    )


def ar1_forecast(
    series: DataFrame, fits: DataFrame, keys: Sequence[str], value: str, horizon: DataFrame,
    position: str = "bin",
) -> DataFrame:
    """h-step forecasts of AR(1) fits with d of 0 or 1, in closed form.

    horizon holds (keys, h): the number of steps for each series.
    """
    by = [*keys, "d"]
    rows = differenced(series, keys, value, (0, 1), position)
    last = rows.groupBy(*by).agg(
        F.max(position).alias("_end"),
        F.max_by("diff", position).alias("_w"),
        F.max_by(value, position).alias("_y"),
    )
    start = join_on(join_on(last, fits.select(*by, "intercept", "slope"), by), horizon, keys)
    steps = start.filter("h > 0").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("h").cast("int"))))
    c, a, w, k = F.col("intercept"), F.col("slope"), F.col("_w"), F.col("step")
    power = F.pow(a, k)
    level = F.try_divide(c, 1.0 - a)
    # A slope of exactly 1 has no level: the forecast is then a straight line.
    change = F.when(a == 1.0, w + c * k).otherwise(level + power * (w - level))
    total = F.when(a == 1.0, w * k + c * k * (k + 1) / 2).otherwise(
        level * k + (w - level) * F.try_divide(a * (1.0 - power), 1.0 - a)
    )
    return steps.select(
        *by,
        (F.col("_end") + k).alias(position),
        "step",
        F.when(F.col("d") == 0, change).otherwise(F.col("_y") + total).alias("forecast"),
    )


def information_criteria(fits: DataFrame, parameters: Column) -> DataFrame:
    """Gaussian AIC and BIC of conditional fits from rss and n_obs."""
    n = F.col("n_obs")
    fit = n * F.ln(F.try_divide(F.col("rss"), n))
    return fits.withColumns({"aic": fit + 2.0 * parameters, "bic": fit + F.ln(n) * parameters})


# --- general orders ------------------------------------------------------------------------------


def innovations(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    orders: Sequence[int],
    long_ar: int = 10,
    position: str = "bin",
) -> DataFrame:
    """Differences (standardised as z) with the residuals e of a long autoregression.

    For d >= 1 they are scaled by their root mean square about zero. A singular system leaves e NULL.
    """
    by = [*keys, "d"]
    rows = _scaled(differenced(series, keys, value, orders, position), by)
    lags = [f"_z{k}" for k in range(1, long_ar + 1)]
    near = with_neighbours(rows, by, {f"_z{k}": ("z", -k) for k in range(1, long_ar + 1)}, position)
    complete = near.filter(f"_z{long_ar} is not null and z is not null")
    size = long_ar + 2

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            matrices, out = square_matrices(pdf["moments"], size), [None] * len(pdf)
            for first, same in ((0, (pdf["d"] == 0).to_numpy()), (1, (pdf["d"] != 0).to_numpy())):
                solved = solve_blocks(matrices[same], np.arange(first, size - 1))
                for at, (beta, _) in zip(np.flatnonzero(same), solved):
                    out[at] = None if beta is None else [*([0.0] * first), *beta.tolist()]
            yield pdf[by].assign(ar=out)

    schema = T.StructType([*(rows.schema[k] for k in by), T.StructField("ar", T.ArrayType(T.DoubleType()))])
    long_fit = cross_moments(complete, by, [*lags, "z"]).mapInPandas(solve, schema)
    predicted = sum((F.col("ar")[k] * F.col(f"_z{k}") for k in range(1, long_ar + 1)), F.col("ar")[0])
    return (
        join_on(near, long_fit, by, "left")
        .withColumn("e", F.col("z") - predicted)
        .select(*by, position, value, "diff", "z", "e", "_mean", "_std")
    )


def _scaled(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """diff as z, in units of its mean and deviation (d = 0) or of its root mean square about zero."""
    plain, x = F.col("d") == 0, F.col("diff")
    scale = rows.groupBy(*by).agg(
        F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.sqrt(F.avg(x * x)).alias("_r")
    ).select(
        *by,
        F.when(plain, F.col("_m")).otherwise(F.lit(0.0)).alias("_mean"),
        F.when(plain, F.col("_s")).otherwise(F.col("_r")).alias("_std"),
    )
    return join_on(rows, scale, by).withColumn("z", F.try_divide(F.col("diff") - F.col("_mean"), F.col("_std")))


def solve_blocks(matrices: np.ndarray, use: np.ndarray) -> list[tuple[np.ndarray | None, float | None]]:
    """Least squares of the last variable on the variables `use`, for a stack of moment matrices."""
    if not len(use):
        return [(np.zeros(0), float(m[-1, -1])) if np.isfinite(m[-1, -1]) else (None, None) for m in matrices]
    a = matrices[:, use[:, None], use]
    b = matrices[:, use, -1]
    good = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    condition = np.full(len(a), np.inf)
    condition[good] = np.linalg.cond(a[good])
    good &= condition < MAX_CONDITION
    out: list[tuple[np.ndarray | None, float | None]] = [(None, None)] * len(a)
    if good.any():
        beta = np.linalg.solve(a[good], b[good][:, :, None])[:, :, 0]
        rss = np.maximum(matrices[good, -1, -1] - np.einsum("ij,ij->i", beta, b[good]), 0.0)
        for at, one, r in zip(np.flatnonzero(good), beta, rss):
            out[at] = (one, float(r))
    return out


def _lagged(innov: DataFrame, keys: Sequence[str], n: int, position: str) -> DataFrame:
    wanted = {f"_z{k}": ("z", -k) for k in range(1, n)} | {f"_e{k}": ("e", -k) for k in range(1, n)}
    return with_neighbours(innov, [*keys, "d"], wanted, position)


def arima_fit(
    innov: DataFrame, orders: DataFrame, keys: Sequence[str], n: int = 6, position: str = "bin", first: int = 0,
    n_ma: int | None = None,
) -> DataFrame:
    """Fit the given orders (keys, p, d, q with p below n and q below n_ma, or n): coefficients and in-sample MSE.

    All orders of one (series, d) share a common sample, so each fit is a block of one moment matrix
    and the rows are read once. `first` is the first position of the sample: with a common one, fits of different d
    have as many observations too. mse is in units of the series. A matrix reaches Python once, with all its orders.
    Orders that cannot be fitted have NULL results.
    """
    by = [*keys, "d"]
    n_ma = n if n_ma is None else n_ma
    near = _lagged(innov, keys, max(n, n_ma), position).filter(F.col(position) >= first)
    lagged = [*(f"_z{k}" for k in range(1, n)), *(f"_e{k}" for k in range(1, n_ma))]
    needed = " and ".join(["e is not null", *(f"{c} is not null" for c in lagged)])
    names = [*lagged, "z"]
    moments = cross_moments(near.filter(needed), [*by, "_mean", "_std"], names)
    size = len(names) + 1
    wanted = orders.groupBy(*by).agg(F.collect_list(F.struct("p", "q")).alias("orders"))  # at most n * n

    def whole(x: float | None) -> int | None:
        return None if x is None or x != x else int(x)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        results = ["n_obs", "rss", "mse", "intercept", "ar", "ma"]
        for pdf in batches:
            there = pdf["moments"].notna().to_numpy()
            matrices = np.full((len(pdf), size, size), np.nan)
            if there.any():
                matrices[there] = square_matrices(pdf.loc[there, "moments"], size)
            long = [(i, whole(o["p"]), whole(o["q"])) for i, given in enumerate(pdf["orders"]) for o in given]
            out = pdf[[*keys]].iloc[[i for i, _, _ in long]].reset_index(drop=True)
            out["p"], out["q"] = (pd.Series([x[j] for x in long], dtype=object) for j in (1, 2))
            out["d"] = pd.Series([whole(pdf["d"].iloc[i]) for i, _, _ in long], dtype=object)
            plain = (pdf["d"] == 0).to_numpy()
            found: list[tuple] = [(None,) * len(results)] * len(long)
            groups: dict[tuple, list[int]] = {}
            for at, (i, p, q) in enumerate(long):
                if there[i] and p is not None and q is not None:
                    groups.setdefault((p, q, bool(plain[i])), []).append(at)
            for (p, q, constant), places in groups.items():
                use = np.r_[([0] if constant else []), 1 : 1 + p, n : n + q].astype(int)
                owners = [long[at][0] for at in places]
                for at, i, (beta, rss) in zip(places, owners, solve_blocks(matrices[owners], use)):
                    count = int(pdf["n_obs"].iloc[i])
                    if beta is None:
                        found[at] = (count, *((None,) * 5))
                        continue
                    mean, std = pdf["_mean"].iloc[i], pdf["_std"].iloc[i]
                    c, rest = (beta[0], beta[1:]) if constant else (0.0, beta)
                    ar, ma = rest[:p], rest[p:]
                    start = c * std + mean * (1.0 - ar.sum())
                    error = rss * std * std
                    found[at] = (count, error, error / count, float(start), ar.tolist(), ma.tolist())
            for j, name in enumerate(results):
                out[name] = pd.Series([f[j] for f in found], dtype=object)
            yield out[[*keys, "p", "d", "q", *results]]

    schema = T.StructType([
        *(innov.schema[k] for k in keys),
        T.StructField("p", T.IntegerType()),
        T.StructField("d", T.IntegerType()),
        T.StructField("q", T.IntegerType()),
        T.StructField("n_obs", T.LongType()),
        T.StructField("rss", T.DoubleType()),
        T.StructField("mse", T.DoubleType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("ar", T.ArrayType(T.DoubleType())),
        T.StructField("ma", T.ArrayType(T.DoubleType())),
    ])
    return join_on(wanted, moments, by, "left").mapInPandas(fit, schema)


def arima_grid_fit(innov: DataFrame, keys: Sequence[str], n: int = 6, position: str = "bin") -> DataFrame:
    """Every order with p, d, q in 0..n-1 for every series."""
    return arima_fit(innov, order_grid(innov, keys, n), keys, n, position)


def best_order(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The fit of least MSE per series; on ties the first in the order of p, d, q.

    A series without any fit has one row of NULLs.
    """
    rank = F.when(F.col("mse").isNotNull(), F.struct("mse", "p", "d", "q"))
    row = F.struct(*(c for c in fits.columns if c not in keys))
    return fits.groupBy(*keys).agg(F.min_by(row, rank).alias("_best")).select(*keys, "_best.*")


def fitted_values(
    innov: DataFrame, fits: DataFrame, keys: Sequence[str], value: str, n: int = 6, position: str = "bin"
) -> DataFrame:
    """In-sample one-step predictions of one chosen fit per series, in units of the series."""
    by = [*keys, "d"]
    near = join_on(
        _lagged(innov, keys, n, position), fits.select(*by, "p", "q", "intercept", "ar", "ma"), by
    )
    unscaled = [F.col(f"_z{k}") * F.col("_std") + F.col("_mean") for k in range(1, n)]
    past = F.slice(F.array(*unscaled), F.lit(1), F.col("p"))
    shocks = F.slice(F.array(*(F.col(f"_e{k}") * F.col("_std") for k in range(1, n))), F.lit(1), F.col("q"))
    predicted = F.col("intercept") + dot(F.col("ar"), past) + dot(F.col("ma"), shocks)
    return near.withColumn("fitted", F.col(value) - (F.col("diff") - predicted)).filter(
        "fitted is not null"
    ).select(*keys, "p", "d", "q", position, value, "fitted")


def forecast(
    innov: DataFrame, fits: DataFrame, keys: Sequence[str], horizon: DataFrame, n: int = 6,
    position: str = "bin",
) -> DataFrame:
    """h-step forecasts of one chosen fit per series, differencing undone.

    innov must cover every d from 0 to the largest chosen one. The recursion reads one row per
    series that holds the last n differences, residuals and levels.
    """
    ends = innov.filter("d = 0").groupBy(*keys).agg(F.max(position).alias("_end"))
    tail = join_on(innov, ends, keys).filter(F.col(position) > F.col("_end") - n)
    chosen = fits.select(*keys, F.col("d").alias("_chosen"), "p", "q", "intercept", "ar", "ma")
    joined = join_on(tail, chosen, keys)
    is_chosen = F.col("d") == F.col("_chosen")
    newest_first = F.struct((-F.col(position)).alias("o"), F.col("diff").alias("w"), (F.col("e") * F.col("_std")).alias("e"))
    state = joined.groupBy(*keys, "_end").agg(
        F.sort_array(F.collect_list(F.when(is_chosen, newest_first))).alias("_s"),
        F.sort_array(
            F.collect_list(
                F.when(
                    (F.col(position) == F.col("_end")) & (F.col("d") < F.col("_chosen")),
                    F.struct((-F.col("d")).alias("o"), F.col("diff").alias("w")),
                )
            )
        ).alias("_l"),
        *(F.first(c).alias(c) for c in ("_chosen", "p", "q", "intercept", "ar", "ma")),
    )
    ready = join_on(state, horizon, keys).filter("h > 0").withColumns({
        "_w": F.col("_s.w"),
        "_e": F.transform("_s.e", lambda x: F.coalesce(x, F.lit(0.0))),
        "_levels": F.col("_l.w"),
    })

    @F.pandas_udf("array<double>")
    def recurse(
        intercept: pd.Series, ar: pd.Series, ma: pd.Series, w: pd.Series, e: pd.Series,
        levels: pd.Series, h: pd.Series,
    ) -> pd.Series:
        out = []
        for c, phi, theta, past, shocks, level, steps in zip(intercept, ar, ma, w, e, levels, h):
            past, shocks = list(past[: len(phi)]), list(shocks[: len(theta)])
            path = np.empty(int(steps))
            for t in range(int(steps)):
                path[t] = c + float(np.dot(phi, past)) + float(np.dot(theta, shocks))
                past = ([path[t], *past])[: len(phi)]
                shocks = ([0.0, *shocks])[: len(theta)]
            for last in level:
                path = last + np.cumsum(path)
            out.append(path.tolist())
        return pd.Series(out)

    path = recurse("intercept", "ar", "ma", "_w", "_e", "_levels", "h")
    return ready.withColumn("_path", path).select(
        *keys, "p", F.col("_chosen").alias("d"), "q", "_end", F.posexplode("_path").alias("_k", "forecast")
    ).select(
        *keys, "p", "d", "q", (F.col("_end") + F.col("_k") + 1).alias(position),
        (F.col("_k") + 1).alias("step"), "forecast",
    )


# --- comparison ----------------------------------------------------------------------------------


def model_compare(
    split: DataFrame,
    keys: Sequence[str],
    value: str,
    models: dict[str, tuple[DataFrame, DataFrame]],
    position: str = "bin",
) -> DataFrame:
    """Actual values with the fit and forecast of every model, aligned by series and position.

    models maps a label to (fitted values, forecasts), each with keys and position.
    """
    out = split.select(*keys, position, "Timestamp", "split", F.col(value).alias("actual"))
    for label, (fitted, ahead) in models.items():
        rows = fitted.select(*keys, position, F.col("fitted").alias(f"fit_{label}"), F.lit(None).cast("double").alias(f"forecast_{label}"))
        rows = rows.unionByName(
            ahead.select(*keys, position, F.lit(None).cast("double").alias(f"fit_{label}"), F.col("forecast").alias(f"forecast_{label}"))
        )
        out = join_on(out, rows, [*keys, position], "left")
    return out


def holdout_error(
    split: DataFrame, forecasts: DataFrame, keys: Sequence[str], value: str, position: str = "bin"
) -> DataFrame:
    """Mean squared error of forecasts against the known future."""
    test = split.filter("split = 'test'").select(*keys, position, value)
    joined = join_on(test, forecasts, [*keys, position])
    error = F.col(value) - F.col("forecast")
    extra = [c for c in ("p", "d", "q") if c in forecasts.columns]
    return joined.groupBy(*keys, *extra).agg(
        F.count("*").alias("n_test"), F.avg(error * error).alias("mse")
    )
