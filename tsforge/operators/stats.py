"""Statistics of many regular series at once: autocorrelation, unit root, differencing order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsforge.functions.vectors import dot, let
from tsforge.operators.keys import join_on
from tsforge.operators.lags import with_neighbours
from tsforge.session import cut_lineage

# Values in one block of lag_products.
BLOCK = 8_192
# Up to so many lags partial autocorrelations are one expression.
SHORT = 40

# Normal quantiles at 97.5 % and 5 %.
Z_975 = 1.959963984540054
Z_050 = -1.6448536269514722

# MacKinnon (2010) response surface for the Dickey-Fuller test with a constant,
# b0 + b1/n + b2/n^2 + b3/n^3 for each level.
CRITICAL_VALUES = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
# MacKinnon (1994) polynomials for the normal quantile of the p-value (constant).
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
P_SWITCH = -1.61
P_RANGE = (-18.83, 2.74)


def mse(df: DataFrame, actual: str, fitted: str, *keys: str) -> DataFrame:
    """Mean squared error over the rows where both are known."""
    error = F.col(actual) - F.col(fitted)
    return df.groupBy(*keys).agg(F.avg(error * error).alias("mse"))


def lag_products(
    series: DataFrame, keys: Sequence[str], value: str, max_lag: int, position: str = "bin", block: int = BLOCK
) -> DataFrame:
    """keys, products: sums of value[t] * value[t - k] for k = 0..max_lag, as an array; NULL values count as 0.

    Series are cut into blocks at least as long as the reach; a block also gets the max_lag values before it, and all its
    lags come from one Fourier transform. Vectors of blocks are added. The plan does not grow with the reach.
    """
    block = max(block, max_lag)
    home = F.floor(F.col(position) / F.lit(block))
    near_end = F.pmod(F.col(position), F.lit(block)) >= block - max_lag
    copies = F.array_compact(F.array(home, F.when(near_end, home + 1)))
    entry = F.struct(F.col(position).cast("long").alias("at"), F.col(value).cast("double").alias("x"))
    blocks = (
        series.select(*keys, position, value, F.explode(copies).alias("_block"))
        .groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
        .select(*keys, "_block", F.col("_rows.at").alias("at"), F.col("_rows.x").alias("x"))
    )

    def correlate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for number, at, x in zip(pdf["_block"], pdf["at"], pdf["x"]):
                whole = np.zeros(max_lag + block)
                whole[np.asarray(at) - (int(number) * block - max_lag)] = np.nan_to_num(np.asarray(x, float), nan=0.0)
                size = 1 << (len(whole) - 1).bit_length()
                own = whole[max_lag:]
                ahead = np.fft.irfft(np.conj(np.fft.rfft(own, size)) * np.fft.rfft(whole, size), size)
                out.append(ahead[max_lag::-1].tolist())
            yield pdf[[*keys]].assign(products=out)

    schema = T.StructType([*(series.schema[k] for k in keys), T.StructField("products", T.ArrayType(T.DoubleType()))])
    parts = blocks.mapInPandas(correlate, schema)
    sums = parts.select(*keys, F.posexplode("products").alias("_k", "_p")).groupBy(*keys, "_k").agg(F.sum("_p").alias("_p"))
    return sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_p"))).alias("_s")).select(
        *keys, F.col("_s._p").alias("products")
    )


def acf_array(
    series: DataFrame, keys: Sequence[str], value: str, max_lag: int, position: str = "bin"
) -> DataFrame:
    """Autocorrelations of lags 0..max_lag per series as one array, with the series length.

    NULL beyond the series' own reach of n - 1 lags, and for constant series.
    """
    facts = series.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.count(value).alias("n"), (F.min(value) < F.max(value)).alias("_varies")
    )
    centred = join_on(series, facts, keys).withColumn("_x", F.col(value) - F.col("_mean"))
    products = lag_products(centred.select(*keys, position, "_x"), keys, "_x", max_lag, position)
    power = F.col("products")[0]

    def ratio(p: Column, k: Column) -> Column:
        return F.when(k == 0, F.lit(1.0)).when(F.col("_varies") & (k < F.col("n")), F.try_divide(p, power))

    return join_on(products, facts, keys).select(*keys, "n", F.transform("products", ratio).alias("acf"))


def acf(series: DataFrame, keys: Sequence[str], value: str, max_lag: int, position: str = "bin") -> DataFrame:
    """Autocorrelation in long form: lag, acf."""
    return acf_array(series, keys, value, max_lag, position).select(
        *keys, F.posexplode("acf").alias("lag", "acf")
    )


def partial_autocorrelations(r: Column) -> Column:
    """Durbin-Levinson recursion over an array of autocorrelations r[0..K], as one expression."""
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), F.array(F.lit(1.0)).alias("out"))

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        lower = F.slice(r, 2, k - 1)
        top = F.element_at(r, k + 1) - dot(phi, F.reverse(lower))
        newest = F.try_divide(top, 1.0 - dot(phi, lower))

        def extended(last: Column) -> Column:
            moved = F.zip_with(phi, F.reverse(phi), lambda p, q: p - last * q)
            return F.struct(
                F.concat(moved, F.array(last)).alias("phi"),
                F.concat(state["out"], F.array(last)).alias("out"),
            )

        return let(newest, extended)

    return F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), start, step, lambda s: s["out"])


def pacf_array(
    series: DataFrame, keys: Sequence[str], value: str, max_lag: int, position: str = "bin"
) -> DataFrame:
    r = acf_array(series, keys, value, max_lag, position)
    if max_lag <= SHORT:
        return r.withColumn("pacf", partial_autocorrelations(F.col("acf")))

    def recursion(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(pacf=[levinson(np.array(a, float)).tolist() for a in pdf["acf"]])

    schema = T.StructType([*r.schema.fields, T.StructField("pacf", T.ArrayType(T.DoubleType()))])
    nan_is_null = F.transform("pacf", lambda x: F.when(~F.isnan(x), x))
    return r.mapInPandas(recursion, schema).withColumn("pacf", nan_is_null)


def levinson(r: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion over autocorrelations r[0..K], a row of K steps at a time; NaN where it breaks down."""
    out = np.full(len(r), np.nan)
    out[0] = 1.0
    phi = np.zeros(0)
    for k in range(1, len(r)):
        below = 1.0 - phi @ r[1:k]
        if not np.isfinite(below) or below == 0.0 or not np.isfinite(r[k]):
            break
        out[k] = (r[k] - phi @ r[k - 1 : 0 : -1]) / below
        phi = np.append(phi - out[k] * phi[::-1], out[k])
    return out


def pacf(series: DataFrame, keys: Sequence[str], value: str, max_lag: int, position: str = "bin") -> DataFrame:
    """Partial autocorrelation in long form: lag, pacf."""
    return pacf_array(series, keys, value, max_lag, position).select(
        *keys, F.posexplode("pacf").alias("lag", "pacf")
    )


def significant_lags(
    series: DataFrame, keys: Sequence[str], value: str, max_lag: int, position: str = "bin"
) -> DataFrame:
    """Lags after 0 before the first one inside the 95 % band, for ACF (Bartlett) and PACF; NULL if none of the
    first max_lag lags is inside.

    The published procedure takes p from n_acf and q from n_pacf; textbooks do the reverse.
    """
    both = pacf_array(series, keys, value, max_lag, position)
    lags = F.sequence(F.lit(1), F.lit(max_lag))

    def bartlett(k: Column) -> Column:
        earlier = F.aggregate(F.slice("acf", 2, k - 1), F.lit(0.0), lambda s, x: s + x * x)
        return F.lit(Z_975) * F.sqrt((1.0 + 2.0 * earlier) / F.col("n"))

    def count_before(array: str, band) -> Column:
        inside = let(
            F.col(array),
            lambda values: F.filter(lags, lambda k: F.abs(F.element_at(values, k + 1)) <= band(k)),
        )
        return F.array_min(inside) - 1

    return both.select(
        *keys,
        count_before("acf", bartlett).alias("n_acf"),
        count_before("pacf", lambda k: F.lit(Z_975) / F.sqrt("n")).alias("n_pacf"),
    )


def significant_lags_to_end(
    series: DataFrame, keys: Sequence[str], value: str, max_lag: int, position: str = "bin"
) -> DataFrame:
    """significant_lags without a bound: series that lack a lag inside the band are searched again with twice the reach
    until it is found or the series ends. NULL only for constant series and those that end first."""
    length = F.count(value).alias("_n")
    varies = F.coalesce(F.min(value) < F.max(value), F.lit(False)).alias("_varies")
    lengths = cut_lineage(series.groupBy(*keys).agg(length, varies))
    rest, done, reach = series, None, max_lag
    while True:
        lags = significant_lags(rest, keys, value, reach, position)
        lags = cut_lineage(join_on(lags, lengths, keys))
        further = (F.col("n_acf").isNull() | F.col("n_pacf").isNull()) & F.col("_varies") & (F.col("_n") - 1 > reach)
        closed = lags.filter(~further).drop("_n", "_varies")
        done = closed if done is None else done.unionByName(closed)
        longest = lags.filter(further).agg(F.max("_n")).first()[0]
        if longest is None:
            return done
        rest = join_on(series, lags.filter(further).select(*keys), keys)
        reach = min(2 * reach, longest - 1)


def lag_differences(
    series: DataFrame, keys: Sequence[str], value: str, max_d: int, position: str = "bin"
) -> DataFrame:
    """x[t] - x[t + d] for d = 0..max_d in long form, rows without a difference dropped."""
    near = with_neighbours(
        series.select(*keys, position, value),
        keys,
        {f"_later{d}": (value, d) for d in range(1, max_d + 1)},
        position,
    )
    each = [F.struct(F.lit(0).alias("d"), F.col(value).alias("diff"))]
    each += [
        F.struct(F.lit(d).alias("d"), (F.col(value) - F.col(f"_later{d}")).alias("diff"))
        for d in range(1, max_d + 1)
    ]
    return near.select(*keys, position, F.inline(F.array(*each))).dropna(subset=["diff"])


def critical_value(level: str, n: Column) -> Column:
    b0, b1, b2, b3 = CRITICAL_VALUES[level]
    return F.lit(b0) + F.lit(b1) / n + F.lit(b2) / (n * n) + F.lit(b3) / (n * n * n)


def p_value_quantile(stat: Column) -> Column:
    """Normal quantile of the approximate p-value; p <= 0.05 exactly when this is <= Z_050."""

    def poly(coefficients: Sequence[float]) -> Column:
        total = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            total = total * stat + F.lit(c)
        return total

    low, high = P_RANGE
    return (
        F.when(stat < low, F.lit(float("-inf")))
        .when(stat > high, F.lit(float("inf")))
        .when(stat <= P_SWITCH, poly(P_SMALL))
        .otherwise(poly(P_LARGE))
    )


def _with_verdict(stats: DataFrame) -> DataFrame:
    n = F.col("n_obs").cast("double")
    return stats.withColumns({c: critical_value(c, n) for c in CRITICAL_VALUES}).withColumn(
        "p_quantile", p_value_quantile(F.col("stat"))
    )


def unit_root(
    series: DataFrame, keys: Sequence[str], value: str, position: str = "bin"
) -> DataFrame:
    """Dickey-Fuller test with a constant and no lagged differences, per series."""
    near = with_neighbours(series, keys, {"_before": (value, -1)}, position)
    change = F.col(value) - F.col("_before")
    sums = near.filter("_before is not null").groupBy(*keys).agg(
        F.count("*").alias("n_obs"),
        F.regr_slope(change, F.col("_before")).alias("_slope"),
        F.regr_sxx(change, F.col("_before")).alias("_sxx"),
        F.regr_sxy(change, F.col("_before")).alias("_sxy"),
        F.regr_syy(change, F.col("_before")).alias("_syy"),
    )
    rss = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    variance = F.try_divide(rss, (F.col("n_obs") - 2) * F.col("_sxx"))
    stat = F.try_divide(F.col("_slope"), F.sqrt(variance))
    return _with_verdict(sums.select(*keys, "n_obs", stat.alias("stat")))


def standardised(series: DataFrame, keys: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Add the value in units of its series' mean and deviation, with _mean and _std."""
    scale = series.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")
    )
    return join_on(series, scale, keys).withColumn(
        name, F.try_divide(F.col(value) - F.col("_mean"), F.col("_std"))
    )


def cross_moments(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums of all products of the columns and a leading 1, row by row of the upper triangle.

    Partial sums are formed before the shuffle, so a long series costs one row per task.
    """
    terms = [F.lit(1.0), *(F.col(c) for c in columns)]
    sums = [F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.array(*sums).alias("moments"))


def square_matrices(moments: pd.Series, size: int) -> np.ndarray:
    """Symmetric matrices from rows of cross_moments."""
    flat = np.array([np.asarray(m, dtype=float) for m in moments]).reshape(len(moments), -1)
    full = np.zeros((len(flat), size, size))
    i, j = np.triu_indices(size)
    full[:, i, j] = flat
    full[:, j, i] = flat
    return full


def _dickey_fuller_fit(matrix: np.ndarray, lags: int, n: float) -> tuple[float, float]:
    """Statistic of the level term and residual sum of squares with `lags` lagged differences.

    Variables are ordered 1, level, lagged differences, response (last).
    """
    use = np.arange(2 + lags)
    a, b = matrix[np.ix_(use, use)], matrix[use, -1]
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    rss = max(float(matrix[-1, -1] - beta @ b), 0.0)
    deviation = np.sqrt(rss / (n - len(use)) * inverse[1, 1])
    return float(beta[1] / deviation), rss


def _augmented_rows(df: DataFrame, keys: Sequence[str], value: str, max_lag: int, position: str) -> DataFrame:
    z = standardised(df, keys, value).select(*keys, position, "z")
    wanted = {f"_y{k}": ("z", -k) for k in range(1, max_lag + 2)}
    near = with_neighbours(z, keys, wanted, position)
    level = {0: F.col("z"), **{k: F.col(f"_y{k}") for k in range(1, max_lag + 2)}}
    return near.select(
        *keys,
        position,
        F.col("_y1").alias("level"),
        *((level[k] - level[k + 1]).alias(f"change{k}") for k in range(0, max_lag + 1)),
    )


def default_max_lag(n: Column) -> Column:
    """Fixed rule of the usual test: 12 * (n / 100)^(1/4) lags at most, and fewer than half the rows."""
    by_length = F.ceil(F.lit(12.0) * F.pow(n / F.lit(100.0), F.lit(0.25)))
    return F.greatest(F.least(by_length, F.floor(n / 2) - 2), F.lit(0)).cast("int")


def unit_root_augmented(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    max_lag: int | None = None,
    choose: bool = True,
    position: str = "bin",
) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant.

    With choose, the number of lagged differences 0..max_lag is the one of least AIC on the common
    sample, and the statistic is computed on all rows which that number allows. Without max_lag each series has the
    usual one of its length. Positions start at 0. Series too short or constant have NULL results.
    Only the moment matrices (one small row per series) reach Python.
    """
    lengths = series.groupBy(*keys).agg(F.count(value).alias("_n"))
    if max_lag is None:
        limits = lengths.select(*keys, default_max_lag(F.col("_n")).alias("_limit"))
        max_lag = limits.agg(F.max("_limit")).first()[0] or 0
    else:
        limits = lengths.select(*keys, F.lit(max_lag).alias("_limit"))
    rows = join_on(_augmented_rows(series, keys, value, max_lag, position), limits, keys)
    variables = ["level", *(f"change{k}" for k in range(1, max_lag + 1)), "change0"]
    size = len(variables) + 1
    key_fields = [series.schema[k] for k in keys]
    if choose:
        def best_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                used = []
                for matrix, n, limit in zip(square_matrices(pdf["moments"], size), pdf["n_obs"], pdf["_limit"]):
                    scores = []
                    for lags in range(limit + 1):
                        try:
                            rss = _dickey_fuller_fit(matrix, lags, n)[1]
                            scores.append(n * np.log(rss / n) + 2 * (2 + lags) if rss > 0 else -np.inf)
                        except np.linalg.LinAlgError:
                            scores.append(np.inf)
                    used.append(int(np.argmin(scores)))
                yield pdf[list(keys)].assign(used_lag=used)

        complete = rows.filter(F.col(position) > F.col("_limit")).fillna(0.0, subset=variables)
        chosen = cross_moments(complete, [*keys, "_limit"], variables).mapInPandas(
            best_of, T.StructType([*key_fields, T.StructField("used_lag", T.IntegerType())])
        )
    else:
        chosen = limits.select(*keys, F.col("_limit").alias("used_lag"))
    allowed = join_on(rows, chosen, keys).filter(F.col(position) > F.col("used_lag"))
    # Lags beyond the chosen number are not read, so their missing leading values may count as 0.
    full = cross_moments(allowed.dropna(subset=["level", "change0"]).fillna(0.0, subset=variables), [*keys, "used_lag"], variables)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stats = []
            for matrix, n, lags in zip(square_matrices(pdf["moments"], size), pdf["n_obs"], pdf["used_lag"]):
                try:
                    stat = _dickey_fuller_fit(matrix, lags, n)[0] if n > 2 + lags else None
                    stats.append(stat if stat is not None and np.isfinite(stat) else None)
                except np.linalg.LinAlgError:
                    stats.append(None)
            yield pdf[[*keys, "used_lag", "n_obs"]].assign(stat=stats)

    schema = T.StructType([
        *key_fields,
        T.StructField("used_lag", T.IntegerType()),
        T.StructField("n_obs", T.LongType()),
        T.StructField("stat", T.DoubleType()),
    ])
    return _with_verdict(join_on(lengths.select(*keys), full.mapInPandas(final, schema), keys, "left"))


def choose_d(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    max_d: int,
    max_lag: int | None = 0,
    position: str = "bin",
) -> DataFrame:
    """Smallest d in 0..max_d whose lag-d difference rejects a unit root at 5 %; NULL when none does.

    All d are tested in one pass. max_lag 0 is the plain test; more, or None for the usual number of the length, is the
    augmented test with chosen lag number.
    """
    rows = lag_differences(series, keys, value, max_d, position)
    by = [*keys, "d"]
    if max_lag != 0:
        tests = unit_root_augmented(rows, by, "diff", max_lag, True, position)
    else:
        tests = unit_root(rows, by, "diff", position)
    rejected = F.when(F.col("p_quantile") <= Z_050, F.col("d"))
    return tests.groupBy(*keys).agg(F.min(rejected).alias("d"))
