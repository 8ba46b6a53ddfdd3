"""Price records to daily series, model orders, forecasts and their comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.config import SpotConfig
from tsforge.functions.numeric import price_to_double
from tsforge.operators.arima import (
    arima_fit,
    best_order,
    forecast,
    holdout_error,
    information_criteria,
    innovations,
    model_compare,
    order_grid,
)
from tsforge.operators.css import css_fit, own_fitted, with_own_errors
from tsforge.operators.grid import fill_series, resample_mean
from tsforge.operators.keys import join_on
from tsforge.operators.position import chronological_split
from tsforge.operators.stats import choose_d, significant_lags_to_end
from tsforge.session import cut_lineage

VALUE = "spot_price"
LONG_AR = 10


@dataclass(frozen=True)
class SpotForecast:
    split: DataFrame
    visual: DataFrame
    best: DataFrame
    comparison: DataFrame
    errors: DataFrame


def merge_batches(*batches: DataFrame) -> DataFrame:
    """Union of overlapping batches, each distinct record once."""
    merged = batches[0]
    for b in batches[1:]:
        merged = merged.unionByName(b)
    return merged.dropDuplicates()


def daily_series(records: DataFrame, keys: Sequence[str], config: SpotConfig) -> DataFrame:
    """Distinct records to the mean price per bin; empty bins are NULL."""
    priced = merge_batches(records).withColumn("price", price_to_double("SpotPrice"))
    return resample_mean(priced, keys, config.bin_seconds, name=VALUE)


def visual_orders(train: DataFrame, keys: Sequence[str], config: SpotConfig) -> DataFrame:
    """Orders read off the correlations (p from ACF, q from PACF) and the unit-root search (d)."""
    lags = significant_lags_to_end(train, keys, VALUE, config.max_lag)
    d = choose_d(train, keys, VALUE, config.max_difference, None)
    return join_on(lags, d, keys).select(
        *keys, F.col("n_acf").alias("p"), "d", F.col("n_pacf").alias("q")
    )


def with_criteria(fits: DataFrame) -> DataFrame:
    """AIC and BIC; parameters are variance, all coefficients and, for d = 0, the constant."""
    return information_criteria(fits, F.col("p") + F.col("q") + 1 + (F.col("d") == 0).cast("int"))


def run(records: DataFrame, keys: Sequence[str], config: SpotConfig) -> SpotForecast:
    """The whole comparison for every series at once.

    The binned means, the split series and the innovations are each read by several later steps, so
    they are written to the shared folder once. Both models of a series are fitted on one common sample, whatever
    their orders, so that their criteria can be compared. Series whose visual orders lie beyond max_lag are fitted
    apart, by doubled numbers of lags, so that the samples of the others do not depend on them.
    """
    means = cut_lineage(daily_series(records, keys, config))
    series = fill_series(means, VALUE, keys)
    split = cut_lineage(chronological_split(series, config.train_fraction, keys))
    train = split.filter("split = 'train'").select(*keys, "bin", VALUE)
    horizon = split.groupBy(*keys).agg(F.count(F.when(F.col("split") == "test", F.lit(1))).alias("h"))
    orders = range(max(config.n_grid, config.max_difference + 1))
    innov = cut_lineage(innovations(train, keys, VALUE, orders, LONG_AR))

    base = max(config.max_lag + 1, config.n_grid)

    def doublings(order: str) -> Column:
        lags = F.coalesce(order, F.lit(0)) + 1
        return F.greatest(F.ceil(F.log2(lags / F.lit(base))), F.lit(0)).cast("int")

    level = F.struct(doublings("p").alias("ar"), doublings("q").alias("ma"))
    wanted = cut_lineage(visual_orders(train, keys, config).withColumn("_level", level))
    levels = sorted(tuple(r[0]) for r in wanted.select("_level").distinct().collect()) or [(0, 0)]
    grid = order_grid(train, keys, config.n_grid)
    visual, best, parts = None, None, []
    for ar, ma in levels:
        n_ar, n_ma = base * 2**ar, base * 2**ma
        reach = max(n_ar, n_ma)
        # Residuals of an autoregression no longer than p would be sums of the model's own lags.
        long_ar = max(LONG_AR, n_ar) if ar else LONG_AR
        first = max(n_ar - 1, long_ar + n_ma - 1) + max(orders)
        chosen = wanted.filter((F.col("_level.ar") == ar) & (F.col("_level.ma") == ma)).drop("_level")
        members = chosen.select(*keys)
        if long_ar > LONG_AR:
            rows = cut_lineage(innovations(join_on(train, members, keys), keys, VALUE, orders, long_ar))
        else:
            rows = innov if len(levels) == 1 else join_on(innov, members, keys)
        # Regressions give the coefficients from which each model's own errors are minimised.
        seen = cut_lineage(arima_fit(rows, chosen, keys, n_ar, first=first, n_ma=n_ma))
        least = cut_lineage(arima_fit(rows, join_on(grid, members, keys), keys, base, first=first))
        seen = cut_lineage(with_criteria(css_fit(rows, seen, keys)))
        least = cut_lineage(with_criteria(best_order(css_fit(rows, least, keys), keys)))
        parts.append((rows, reach, {"visual": seen, "best": least}))
        visual = seen if visual is None else visual.unionByName(seen)
        best = least if best is None else best.unionByName(least)

    models, errors = {}, None
    every = split.select(*keys).distinct()
    for label in ("visual", "best"):
        fitted = ahead = None
        for rows, reach, fits in parts:
            usable = fits[label].filter("mse is not null")
            inside = own_fitted(rows, usable, keys, VALUE)
            later = forecast(with_own_errors(rows, usable, keys), usable, keys, horizon, reach)
            fitted = inside if fitted is None else fitted.unionByName(inside)
            ahead = later if ahead is None else ahead.unionByName(later)
        models[label] = (fitted, ahead)
        error = join_on(every, holdout_error(split, ahead, keys, VALUE), keys, "left").withColumn("model", F.lit(label))
        errors = error if errors is None else errors.unionByName(error)
    comparison = model_compare(split, keys, VALUE, models)
    return SpotForecast(split, visual, best, comparison, errors)
