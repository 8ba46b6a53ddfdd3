"""Registered queries of the spot-price pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.catalog import fixtures as fx
from tsforge.catalog.registry import n, query, r, single
from tsforge.config import SpotConfig
from tsforge.functions.numeric import price_to_double
from tsforge.operators.arima import (
    ar1_fit,
    ar1_fitted,
    ar1_forecast,
    arima_grid_fit,
    best_order,
    fitted_values,
    forecast,
    holdout_error,
    information_criteria,
    innovations,
    model_compare,
    order_grid,
)
from tsforge.operators.chains import chain_report, page_chains
from tsforge.operators.css import css_fit, own_fitted, with_own_errors
from tsforge.operators.lags import drop_missing, iterated_difference, lag_difference
from tsforge.operators.quality import split_covers_all
from tsforge.operators.stats import (
    Z_050,
    acf,
    choose_d,
    lag_differences,
    mse,
    pacf,
    significant_lags,
    unit_root,
    unit_root_augmented,
)
from tsforge.plans import spot_forecast
from tsforge.session import cut_lineage, scratch_path
from tsforge.sources.spot import read_pages, read_series, records_of_pages, save_series
from tsforge.streaming.series import merge_bins, run_to_end, stream_bins, stream_dedupe, stream_dedupe_within, with_late

KEYS = fx.SERIES
VALUE = "spot_price"
LAGS = 10


# --- sources, cleaning, resampling ---


@query(
    "spot_pages_ingest",
    'SELECT series, "Timestamp", "SpotPrice", count(*) AS copies FROM page_copies GROUP BY 1, 2, 3',
)
def _(spark, sf_dir):
    path = scratch_path(spark, "pages")
    fx.spot_pages(spark, sf_dir).select("SpotPriceHistory", "NextToken").write.json(path)
    records = records_of_pages(read_pages(spark, path))
    return records.groupBy(F.col("InstanceType").alias("series"), "Timestamp", "SpotPrice").agg(
        F.count("*").alias("copies")
    )


@query("page_chains", "SELECT series, token, chain, CAST(steps AS BIGINT) AS steps, missing, cycle FROM link_chains")
def _(spark, sf_dir):
    return page_chains(fx.page_links(spark, sf_dir), KEYS)


@query(
    "chain_report",
    """SELECT series, chain, cycle, count(*) AS pages, CAST(max(steps) + 1 AS BIGINT) AS longest, any_value(missing) AS missing
       FROM link_chains GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    return chain_report(page_chains(fx.page_links(spark, sf_dir), KEYS), KEYS)


@query(
    "spot_csv_scan",
    """SELECT series, "Timestamp", round(spot_price, 4) AS spot_price FROM spot_series""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "series")
    save_series(fx.spot_series(spark, sf_dir), path, *KEYS)
    return read_series(spark, path, *KEYS).select(*KEYS, "Timestamp", r(VALUE, 4))


@query(
    "spot_csv_sink",
    """SELECT series, strftime("Timestamp", '%Y-%m-%d %H:%M:%S') || '+00:00' AS "Timestamp",
              round(spot_price, 4) AS spot_price FROM spot_daily""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "series")
    save_series(fx.spot_daily(spark, sf_dir), path, *KEYS)
    raw = spark.read.schema("series string, Timestamp string, spot_price double").csv(path, header=True)
    return raw.select(*KEYS, "Timestamp", r(VALUE, 4))


@query(
    "price_to_double",
    """SELECT series, o_orderkey, price FROM spot_records""",
)
def _(spark, sf_dir):
    return fx.spot_records(spark, sf_dir).select(
        *KEYS, "o_orderkey", price_to_double("SpotPrice").alias("price")
    )


@query("dedupe_union", 'SELECT DISTINCT series, "Timestamp", "SpotPrice" FROM spot_records')
def _(spark, sf_dir):
    batches = records_of_pages(fx.spot_pages(spark, sf_dir), "page")
    even = batches.filter("page % 2 = 0").drop("page")
    odd = batches.filter("page % 2 = 1").drop("page")
    merged = spot_forecast.merge_batches(even, odd)
    return merged.select(F.col("InstanceType").alias("series"), "Timestamp", "SpotPrice")


@query("resample_mean", 'SELECT series, "Timestamp", bin, round(spot_price, 4) AS spot_price FROM spot_daily')
def _(spark, sf_dir):
    return fx.spot_daily(spark, sf_dir).select(*KEYS, "Timestamp", "bin", r(VALUE, 4))


@query(
    "resample_mean_odd_width",
    """WITH g AS (SELECT *, min(day0) OVER (PARTITION BY series) AS origin FROM (
            SELECT series, price, CAST(epoch("Timestamp") AS BIGINT) AS e,
                   CAST(floor(epoch("Timestamp") / 86400) AS BIGINT) * 86400 AS day0 FROM spot_records)),
       m AS (SELECT series, origin, (e - origin) // 25200 AS b, avg(price) AS spot_price FROM g GROUP BY 1, 2, 3)
       SELECT s.series, make_timestamp((s.origin + s.b * 25200) * 1000000) AS "Timestamp", s.b - s.lo AS bin,
              round(m.spot_price, 4) AS spot_price
       FROM (SELECT series, origin, min(b) AS lo, unnest(range(min(b), max(b) + 1)) AS b FROM m GROUP BY 1, 2) s
       LEFT JOIN m ON m.series = s.series AND m.b = s.b""".replace("FROM spot_records", """FROM (
            SELECT o_orderpriority AS series, o_orderdate AS "Timestamp", o_totalprice AS price FROM orders)"""),
)
def _(spark, sf_dir):
    # Seven hours do not divide a day, so bins are counted from each series' first midnight.
    return fx.spot_daily(spark, sf_dir, 7 * 3600).select(*KEYS, "Timestamp", "bin", r(VALUE, 4))


@query(
    "fill_series",
    'SELECT series, "Timestamp", bin, round(spot_price, 4) AS spot_price FROM spot_series',
)
def _(spark, sf_dir):
    return fx.spot_series(spark, sf_dir).select(*KEYS, "Timestamp", "bin", r(VALUE, 4))


# --- splits ---


@query("chronological_split", "SELECT series, bin, split FROM spot_split")
def _(spark, sf_dir):
    return fx.spot_split(spark, sf_dir).select(*KEYS, "bin", "split")


@query(
    "split_covers_all",
    """SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
              count(*) AS n_all, true AS covers_all FROM spot_split""",
)
def _(spark, sf_dir):
    return split_covers_all(fx.spot_split(spark, sf_dir))


# --- differences ---


@query(
    "lag_difference",
    """SELECT series, bin, round(spot_price - lead(spot_price, 3) OVER (PARTITION BY series ORDER BY bin), 3)
              AS diff FROM spot_train""",
)
def _(spark, sf_dir):
    return lag_difference(fx.spot_train(spark, sf_dir), KEYS, VALUE, 3).select(*KEYS, "bin", r("diff", 3))


@query(
    "drop_missing",
    """SELECT * FROM (SELECT series, bin, round(spot_price - lead(spot_price, 1) OVER (PARTITION BY series
              ORDER BY bin), 3) AS diff FROM spot_train) WHERE diff IS NOT NULL""",
)
def _(spark, sf_dir):
    rows = lag_difference(fx.spot_train(spark, sf_dir), KEYS, VALUE, 1)
    return drop_missing(rows, "diff").select(*KEYS, "bin", r("diff", 3))


@query(
    "iterated_difference",
    """SELECT series, bin, CAST(d AS BIGINT) AS d, round(w, 3) AS diff FROM ar1_diffs""",
)
def _(spark, sf_dir):
    rows = iterated_difference(fx.spot_train(spark, sf_dir), KEYS, VALUE, (0, 1, 2))
    return drop_missing(rows, "diff").select(*KEYS, "bin", n("d"), r("diff", 3))


# --- statistics ---


@query("acf", "SELECT series, lag, round(r, 6) AS acf FROM acf_long")
def _(spark, sf_dir):
    return acf(fx.spot_train(spark, sf_dir), KEYS, VALUE, LAGS).select(*KEYS, n("lag"), r("acf"))


@query(
    "acf_long_reach",
    """SELECT p.series, p.lag, round(p.s / z.s, 6) AS acf
       FROM (SELECT a.series, a.bin - b.bin AS lag, sum((a.spot_price - m.m) * (b.spot_price - m.m)) AS s
             FROM spot_train a JOIN spot_train b ON b.series = a.series AND b.bin BETWEEN a.bin - 500 AND a.bin
             JOIN (SELECT series, avg(spot_price) AS m FROM spot_train GROUP BY 1) m ON m.series = a.series
             GROUP BY 1, 2) p
       JOIN (SELECT series, sum((spot_price - m) * (spot_price - m)) AS s
             FROM spot_train JOIN (SELECT series, avg(spot_price) AS m FROM spot_train GROUP BY 1) USING (series)
             GROUP BY 1) z ON z.series = p.series""",
)
def _(spark, sf_dir):
    return acf(fx.spot_train(spark, sf_dir), KEYS, VALUE, 500).select(*KEYS, n("lag"), r("acf"))


@query(
    "pacf",
    """SELECT series, k AS lag, round(last, 6) AS pacf FROM levinson
       UNION ALL SELECT DISTINCT series, 0, 1.0 FROM acf_lists""",
)
def _(spark, sf_dir):
    return pacf(fx.spot_train(spark, sf_dir), KEYS, VALUE, LAGS).select(*KEYS, n("lag"), r("pacf"))


@query(
    "significant_lags",
    """SELECT series, min(lag) FILTER (WHERE abs(r) <= acf_band) - 1 AS n_acf,
              min(lag) FILTER (WHERE abs(last) <= pacf_band) - 1 AS n_pacf
       FROM (SELECT a.series, a.lag, a.r, v.last, 1.959963984540054 / sqrt(a.n) AS pacf_band,
                    1.959963984540054 * sqrt((1 + 2 * coalesce(sum(a.r * a.r) OVER (PARTITION BY a.series
                    ORDER BY a.lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / a.n) AS acf_band
             FROM acf_long a JOIN levinson v ON v.series = a.series AND v.k = a.lag WHERE a.lag > 0)
       GROUP BY 1""",
)
def _(spark, sf_dir):
    return significant_lags(fx.spot_train(spark, sf_dir), KEYS, VALUE, LAGS).select(
        *KEYS, n("n_acf"), n("n_pacf")
    )


@query(
    "unit_root",
    """SELECT series, CAST(d AS BIGINT) AS d, n_obs, round(stat, 5) AS stat,
              round(-3.43035 - 6.5393 / n_obs - 16.786 / (n_obs * n_obs) - 79.433 / (n_obs * n_obs * n_obs), 5) AS crit_1,
              round(-2.86154 - 2.8903 / n_obs - 4.234 / (n_obs * n_obs) - 40.040 / (n_obs * n_obs * n_obs), 5) AS crit_5,
              round(-2.56677 - 1.5384 / n_obs - 2.809 / (n_obs * n_obs), 5) AS crit_10
       FROM df_tests""",
)
def _(spark, sf_dir):
    rows = lag_differences(fx.spot_train(spark, sf_dir), KEYS, VALUE, 5)
    return unit_root(rows, [*KEYS, "d"], "diff").select(
        *KEYS, n("d"), "n_obs", *(r(c, 5) for c in ("stat", "crit_1", "crit_5", "crit_10"))
    )


@query(
    "unit_root_one_lag",
    """SELECT series, n_obs, round(b / sqrt((yy - b * vy - g * cy) / (n_obs - 3) * cc / (vv * cc - vc * vc)), 5) AS stat
       FROM (SELECT *, (vy * cc - cy * vc) / (vv * cc - vc * vc) AS b, (cy * vv - vy * vc) / (vv * cc - vc * vc) AS g
             FROM (SELECT series, CAST(count(*) AS BIGINT) AS n_obs, regr_sxx(y, v) AS vv, regr_sxx(y, c) AS cc,
                          regr_syy(y, v) AS yy, regr_sxy(y, v) AS vy, regr_sxy(y, c) AS cy, regr_sxy(c, v) AS vc
                   FROM (SELECT series, spot_price - lag(spot_price) OVER o AS y, lag(spot_price) OVER o AS v,
                                lag(spot_price) OVER o - lag(spot_price, 2) OVER o AS c
                         FROM spot_train WINDOW o AS (PARTITION BY series ORDER BY bin)) WHERE c IS NOT NULL
                   GROUP BY 1))""",
)
def _(spark, sf_dir):
    tests = unit_root_augmented(fx.train_of(_split(spark, sf_dir)), KEYS, VALUE, 1, choose=False)
    return tests.select(*KEYS, "n_obs", r("stat", 5))


@query("unit_root_augmented")
def _(spark, sf_dir):
    return unit_root_augmented(fx.train_of(_split(spark, sf_dir)), KEYS, VALUE, LAGS)


@query(
    "choose_d",
    f"""SELECT series, CAST(min(d) FILTER (WHERE p_quantile <= {Z_050!r}) AS BIGINT) AS d
        FROM df_verdict GROUP BY 1""",
)
def _(spark, sf_dir):
    return choose_d(fx.spot_train(spark, sf_dir), KEYS, VALUE, 5).select(*KEYS, n("d"))


# --- models ---


@query(
    "order_grid",
    """SELECT series, p, d, q FROM (SELECT DISTINCT series FROM spot_records), range(6) a(p), range(6) b(d),
              range(6) c(q)""",
)
def _(spark, sf_dir):
    grid = order_grid(fx.spot_records(spark, sf_dir), KEYS, 6)
    return grid.select(*KEYS, n("p"), n("d"), n("q"))


def _split(spark, sf_dir) -> DataFrame:
    """The split series, written once: models read it several times."""
    return cut_lineage(fx.spot_split(spark, sf_dir))


def _fits(train: DataFrame, orders=(0, 1, 2)) -> DataFrame:
    return ar1_fit(train, KEYS, VALUE, orders)


@query(
    "ar1_fit",
    """SELECT series, CAST(d AS BIGINT) AS d, n_obs, round(intercept, 3) AS intercept, round(slope, 6) AS slope,
              round(rss / n_obs, 0) AS mse, round(rss / (n_obs - CASE WHEN d = 0 THEN 2 ELSE 1 END), 0) AS residual_variance FROM ar1_fits""",
)
def _(spark, sf_dir):
    return _fits(fx.train_of(_split(spark, sf_dir))).select(
        *KEYS, n("d"), "n_obs", r("intercept", 3), r("slope"), r("mse", 0), r("residual_variance", 0)
    )


@query(
    "mse",
    """SELECT series, CAST(d AS BIGINT) AS d, round(avg((spot_price - fitted) * (spot_price - fitted)), 0) AS mse
       FROM ar1_fitted GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    train = fx.train_of(_split(spark, sf_dir))
    fitted = ar1_fitted(train, _fits(train), KEYS, VALUE, (0, 1, 2))
    return mse(fitted, VALUE, "fitted", *KEYS, "d").select(*KEYS, n("d"), r("mse", 0))


@query(
    "best_order",
    """SELECT series, CAST(1 AS BIGINT) AS p, CAST(arg_min(d, rss / n_obs) AS BIGINT) AS d, CAST(0 AS BIGINT) AS q,
              round(min(rss / n_obs), 0) AS mse FROM ar1_fits GROUP BY 1""",
)
def _(spark, sf_dir):
    fits = _fits(fx.train_of(_split(spark, sf_dir))).withColumns({"p": F.lit(1), "q": F.lit(0)})
    return best_order(fits, KEYS).select(*KEYS, n("p"), n("d"), n("q"), r("mse", 0))


@query(
    "fitted_values",
    "SELECT series, CAST(d AS BIGINT) AS d, bin, round(fitted, 3) AS fitted FROM ar1_fitted",
)
def _(spark, sf_dir):
    train = fx.train_of(_split(spark, sf_dir))
    fitted = ar1_fitted(train, _fits(train), KEYS, VALUE, (0, 1, 2))
    return fitted.select(*KEYS, n("d"), "bin", r("fitted", 3))


def _ahead(split: DataFrame) -> DataFrame:
    train = fx.train_of(split)
    return ar1_forecast(train, _fits(train, (0, 1)), KEYS, VALUE, fx.horizon_of(split))


@query(
    "forecast",
    "SELECT series, CAST(d AS BIGINT) AS d, bin, step, round(forecast, 3) AS forecast FROM ar1_forecast",
)
def _(spark, sf_dir):
    return _ahead(_split(spark, sf_dir)).select(*KEYS, n("d"), "bin", n("step"), r("forecast", 3))


@query(
    "aic_bic",
    """SELECT series, CAST(d AS BIGINT) AS d, round(n_obs * ln(rss / n_obs) + 2 * CASE WHEN d = 0 THEN 3 ELSE 2 END, 4) AS aic,
              round(n_obs * ln(rss / n_obs) + CASE WHEN d = 0 THEN 3 ELSE 2 END * ln(n_obs), 4) AS bic FROM ar1_fits""",
)
def _(spark, sf_dir):
    parameters = F.when(F.col("d") == 0, 3).otherwise(2)
    fits = information_criteria(_fits(fx.train_of(_split(spark, sf_dir))), parameters)
    return fits.select(*KEYS, n("d"), r("aic", 4), r("bic", 4))


@query(
    "model_compare",
    """SELECT s.series, s.bin, s."Timestamp", s.split, round(s.spot_price, 3) AS actual,
              round(f0.fitted, 3) AS fit_d0, round(a0.forecast, 3) AS forecast_d0,
              round(f1.fitted, 3) AS fit_d1, round(a1.forecast, 3) AS forecast_d1
       FROM spot_split s
       LEFT JOIN ar1_fitted f0 ON f0.series = s.series AND f0.bin = s.bin AND f0.d = 0
       LEFT JOIN ar1_fitted f1 ON f1.series = s.series AND f1.bin = s.bin AND f1.d = 1
       LEFT JOIN ar1_forecast a0 ON a0.series = s.series AND a0.bin = s.bin AND a0.d = 0
       LEFT JOIN ar1_forecast a1 ON a1.series = s.series AND a1.bin = s.bin AND a1.d = 1""",
)
def _(spark, sf_dir):
    split = _split(spark, sf_dir)
    train = fx.train_of(split)
    fitted = ar1_fitted(train, _fits(train, (0, 1)), KEYS, VALUE, (0, 1))
    ahead = _ahead(split)
    models = {f"d{d}": (fitted.filter(F.col("d") == d), ahead.filter(F.col("d") == d)) for d in (0, 1)}
    return model_compare(split, KEYS, VALUE, models).select(
        *KEYS, "bin", "Timestamp", "split",
        *(r(c, 3) for c in ("actual", "fit_d0", "forecast_d0", "fit_d1", "forecast_d1")),
    )


@query(
    "holdout_error",
    """SELECT a.series, CAST(a.d AS BIGINT) AS d, count(*) AS n_test,
              round(avg((s.spot_price - a.forecast) * (s.spot_price - a.forecast)), 0) AS mse
       FROM ar1_forecast a JOIN spot_split s ON s.series = a.series AND s.bin = a.bin
       WHERE s.split = 'test' GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    split = _split(spark, sf_dir)
    error = holdout_error(split, _ahead(split), KEYS, VALUE)
    return error.select(*KEYS, n("d"), "n_test", r("mse", 0))


def _innov(spark, sf_dir) -> DataFrame:
    """Residuals that several steps read, written once."""
    return cut_lineage(innovations(fx.train_of(_split(spark, sf_dir)), KEYS, VALUE, range(6)))


def _grid(innov: DataFrame) -> DataFrame:
    """All orders, started by regression and refitted by their own errors."""
    return css_fit(innov, cut_lineage(arima_grid_fit(innov, KEYS)), KEYS)


@query("arima_grid_fit")
def _(spark, sf_dir):
    return _grid(_innov(spark, sf_dir))


@query(
    "arima_grid_ar",
    """SELECT series, CAST(k AS BIGINT) AS p, CAST(d AS BIGINT) AS d, count(*) AS n_obs,
              CAST(CAST(CASE WHEN k = 0 AND d = 0 THEN var_pop(w) WHEN k = 0 THEN avg(w * w)
                   WHEN d = 0 THEN (regr_syy(w, v) - regr_sxy(w, v) * regr_sxy(w, v) / regr_sxx(w, v)) / count(*)
                   ELSE (sum(w * w) - sum(w * v) * sum(w * v) / sum(v * v)) / count(*) END AS FLOAT) AS DOUBLE) AS mse,
              CASE WHEN k = 1 AND d = 0 THEN round(regr_slope(w, v), 6)
                   WHEN k = 1 THEN round(sum(w * v) / sum(v * v), 6) END AS slope
       FROM ar1_rows, range(2) o(k) WHERE bin >= d + 15 GROUP BY series, k, d""",
)
def _(spark, sf_dir):
    # The part of the grid that has a closed form: no moving average, at most one lag.
    fits = arima_grid_fit(_innov(spark, sf_dir), KEYS).filter("p <= 1 and q = 0 and d <= 2")
    slope = r(F.try_element_at("ar", F.lit(1)))
    return fits.select(*KEYS, n("p"), n("d"), "n_obs", single("mse"), slope.alias("slope"))


def _small(spark, sf_dir):
    """Split and residuals of a one-lag autoregression: orders up to one have a closed form to check against."""
    split = _split(spark, sf_dir)
    return split, cut_lineage(innovations(fx.train_of(split), KEYS, VALUE, range(2), 1))


@query(
    "arima_small_grid",
    """SELECT series, CAST(p AS BIGINT) AS p, CAST(d AS BIGINT) AS d, CAST(q AS BIGINT) AS q, n_obs,
              CAST(CAST(mse AS FLOAT) AS DOUBLE) AS mse, CASE WHEN p = 1 THEN round(a, 5) END AS ar,
              CASE WHEN q = 1 THEN round(b, 5) END AS ma FROM small_fits""",
)
def _(spark, sf_dir):
    fits = arima_grid_fit(_small(spark, sf_dir)[1], KEYS, 2)
    ar, ma = (r(F.try_element_at(c, F.lit(1)), 5).alias(c) for c in ("ar", "ma"))
    return fits.select(*KEYS, n("p"), n("d"), n("q"), "n_obs", single("mse"), ar, ma)


@query(
    "arima_small_best",
    """SELECT series, CAST(best.p AS BIGINT) AS p, CAST(best.d AS BIGINT) AS d, CAST(best.q AS BIGINT) AS q,
              CAST(CAST(best.mse AS FLOAT) AS DOUBLE) AS mse
       FROM (SELECT series, arg_min({'p': p, 'd': d, 'q': q, 'mse': mse}, mse) AS best FROM small_fits GROUP BY 1)""",
)
def _(spark, sf_dir):
    best = best_order(arima_grid_fit(_small(spark, sf_dir)[1], KEYS, 2), KEYS)
    return best.select(*KEYS, n("p"), n("d"), n("q"), single("mse"))


SMALL_ORDER = "p = 1 and d = 1 and q = 1"


@query(
    "arima_small_fitted",
    """SELECT series, bin, round(spot_price - (w - (c + a * v + b * e1)), 2) AS fitted
       FROM small_rows JOIN (SELECT * FROM small_fits WHERE p = 1 AND d = 1 AND q = 1) USING (series, d)""",
)
def _(spark, sf_dir):
    innov = _small(spark, sf_dir)[1]
    chosen = arima_grid_fit(innov, KEYS, 2).filter(SMALL_ORDER)
    return fitted_values(innov, chosen, KEYS, VALUE, 2).select(*KEYS, "bin", r("fitted", 2))


@query(
    "arima_small_forecast",
    """SELECT series, bin_end + k AS bin, k AS step,
              round(y_end + (a * w_end + b * e_end) * (1 - power(a, k)) / (1 - a), 2) AS forecast
       FROM (SELECT *, unnest(range(1, h + 1)) AS k
             FROM (SELECT series, max(bin) AS bin_end, arg_max(w, bin) AS w_end, arg_max(e, bin) AS e_end,
                          arg_max(spot_price, bin) AS y_end FROM small_rows WHERE d = 1 GROUP BY 1)
             JOIN (SELECT series, a, b FROM small_fits WHERE p = 1 AND d = 1 AND q = 1) USING (series)
             JOIN (SELECT series, count(*) AS h FROM spot_split WHERE split = 'test' GROUP BY 1) USING (series))""",
)
def _(spark, sf_dir):
    split, innov = _small(spark, sf_dir)
    chosen = arima_grid_fit(innov, KEYS, 2).filter(SMALL_ORDER)
    ahead = forecast(innov, chosen, KEYS, fx.horizon_of(split), 2)
    return ahead.select(*KEYS, "bin", n("step"), r("forecast", 2))


@query(
    "arima_own_fitted",
    """SELECT o.series, s.bin, round(s.spot_price - o.e, 2) AS fitted
       FROM own_errors o JOIN spot_train s ON s.series = o.series AND s.bin = o.bin0 + o.k - 1 WHERE o.k > 1""",
)
def _(spark, sf_dir):
    # Given coefficients, errors by the model's own recursion; blocks short enough for several a series.
    innov = _small(spark, sf_dir)[1]
    chosen = cut_lineage(arima_grid_fit(innov, KEYS, 2).filter(SMALL_ORDER))
    return own_fitted(innov, chosen, KEYS, VALUE, block=500).select(*KEYS, "bin", r("fitted", 2))


@query(
    "arima_own_forecast",
    """SELECT series, bin0 + len(ws) - 1 + j AS bin, j AS step,
              round(y_end + (a * ws[len(ws)] + b * e) * (1 - power(a, j)) / (1 - a), 2) AS forecast
       FROM (SELECT *, unnest(range(1, h + 1)) AS j
             FROM own_errors JOIN (SELECT series, arg_max(spot_price, bin) AS y_end FROM spot_train GROUP BY 1) USING (series)
             JOIN (SELECT series, count(*) AS h FROM spot_split WHERE split = 'test' GROUP BY 1) USING (series)
             WHERE k = len(ws))""",
)
def _(spark, sf_dir):
    split, innov = _small(spark, sf_dir)
    chosen = cut_lineage(arima_grid_fit(innov, KEYS, 2).filter(SMALL_ORDER))
    ahead = forecast(with_own_errors(innov, chosen, KEYS), chosen, KEYS, fx.horizon_of(split), 2)
    return ahead.select(*KEYS, "bin", n("step"), r("forecast", 2))


@query("arima_best_order")
def _(spark, sf_dir):
    return best_order(_grid(_innov(spark, sf_dir)), KEYS)


@query("arima_fitted")
def _(spark, sf_dir):
    innov = _innov(spark, sf_dir)
    return own_fitted(innov, cut_lineage(best_order(_grid(innov), KEYS)), KEYS, VALUE)


@query("arima_forecast")
def _(spark, sf_dir):
    split = _split(spark, sf_dir)
    innov = cut_lineage(innovations(fx.train_of(split), KEYS, VALUE, range(6)))
    best = cut_lineage(best_order(_grid(innov), KEYS))
    return forecast(with_own_errors(innov, best, KEYS), best, KEYS, fx.horizon_of(split))


@query("spot_forecast_comparison")
def _(spark, sf_dir):
    return spot_forecast.run(
        fx.spot_records(spark, sf_dir).drop("o_orderkey"), KEYS, SpotConfig()
    ).comparison


# --- streaming ---


@query(
    "stream_resample",
    """SELECT instrument, date_trunc('day', ts) AS ts, round(avg(value), 6) AS value
       FROM (SELECT event_type AS instrument, CAST(ts AS TIMESTAMP) AS ts, value FROM events) GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = source.select(F.col("event_type").alias("instrument"), "ts", "value")
    landed = run_to_end(spark, stream_bins(rows, ["instrument"], "1 day", "ts", "value"), "stream-resample")
    return merge_bins(landed, ["instrument"], "ts", "value").select("instrument", "ts", r("value"))


@query("stream_dedupe", 'SELECT DISTINCT series, "Timestamp", "SpotPrice" FROM spot_records')
def _(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "orders").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    records = source.select(
        F.col("o_orderpriority").alias("series"),
        F.col("o_orderdate").alias("Timestamp"),
        F.col("o_totalprice").cast("string").alias("SpotPrice"),
        "o_orderkey",
    )
    copies = fx.page_copies(records).drop("page")
    once = stream_dedupe(copies, ["series", "Timestamp", "SpotPrice"])
    return run_to_end(spark, once, "stream-dedupe")


@query("stream_dedupe_within", 'SELECT DISTINCT series, "Timestamp", "SpotPrice" FROM spot_records')
def _(spark, sf_dir):
    # Copies arrive in several files, each a micro-batch: what one leaves behind the watermark is late in the next.
    columns = ["series", "Timestamp", "SpotPrice"]
    copies, path = fx.page_copies(fx.spot_records(spark, sf_dir)), scratch_path(spark, "copies")
    copies.repartition(4, F.col("page") % 4).write.parquet(path)
    copies = spark.read.schema(copies.schema).parquet(path)
    source = spark.readStream.schema(copies.schema).option("maxFilesPerTrigger", 1).parquet(path)
    landed = run_to_end(spark, stream_dedupe_within(source, columns, "Timestamp", "30 days"), "stream-dedupe-within")
    return with_late(landed, copies, columns)
