"""ARIMA models by their own errors: conditional sums of squares, minimised, for series of any length.

A model predicts its next value from past values and from its own past errors, so an error follows from all errors
before it: e[t] = w[t] - c - sum(phi[i] w[t-i]) - sum(theta[k] e[t-k]), with values and errors before the first one
at their mean. That is a recursive filter, y[t] = x[t] - sum(a[k] y[t-k]), and one that is linear in its past: a block of
values takes the last S outputs before it to the last S of its own by one affine map, whatever those outputs are. Blocks
are filtered from nothing, side by side; the product of the maps before a block gives the outputs it starts from; what
these add is linear in them. Inside a task the same is done with short blocks of one array, so that no step walks
through a series value by value.

Filtering twice with theta, as one filter of twice the order, gives the errors and all their derivatives by lags:
    z2 = F(F(z)), o2 = F(F(1)),  z1 = theta(B) z2, o1 = theta(B) o2
    e = phi(B) z1 - c o1,  de/dc = -o1,  de/dphi[i] = -z1[t-i],  de/dtheta[k] = -(phi(B) z2 - c o2)[t-k]

Models are fitted by damped Gauss-Newton steps on all (series, order) at once. AR and MA parts are written as partial
autocorrelations inside (-LIMIT, LIMIT), so every model on the way is stationary and invertible. A series of one block is
fitted in one task; for longer ones each step is two passes over the blocks and one small row per series and order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsforge.operators.keys import join_on
from tsforge.session import stored, task_count

#: Values in one row of blocks.
BLOCK = 16_384
#: Bound of partial autocorrelations LIMIT * x / sqrt(1 + x^2), and the greatest x.
LIMIT, EDGE = 0.999, 100.0
#: At a minimum no step would take more than this part of the squared error away.
FLAT = 1e-8
MAX_STEPS = 100
STUCK = 1e12
#: Models times values that are held at a time.
AT_ONCE = 1 << 21


# --- the filter ----------------------------------------------------------------------------------


def _short_blocks(feedback: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Outputs of the filter for blocks x (models, blocks, length) behind S outputs (models, blocks, S + length)."""
    size = feedback.shape[1]
    turned = feedback[:, None, ::-1]
    for t in range(x.shape[2] - size):
        x[:, :, size + t] -= (x[:, :, t : t + size] * turned).sum(axis=2)
    return x


def block_map(feedback: np.ndarray, length: int) -> np.ndarray:
    """(models, S, S): what the last S outputs (latest first) become `length` steps later without input."""
    m, size = feedback.shape
    step = np.zeros((m, size, size))
    step[:, 0] = -feedback
    step[:, 1:, :-1] = np.eye(size - 1)
    return np.linalg.matrix_power(step, length)


def filtered(feedback: np.ndarray, x: np.ndarray, start: np.ndarray | None = None, length: int | None = None) -> np.ndarray:
    """y[t] = x[t] - sum over k of feedback[k] * y[t - 1 - k], for each model (row) and its x.

    start: (models, S) outputs before the first, latest first. Returned are these S (earliest first) and y.
    """
    m, size = feedback.shape
    n = x.shape[1]
    length = max(size, length or int(np.sqrt(n)) + 1)
    blocks = max(1, -(-n // length))
    state = np.zeros((m, size)) if start is None else start
    padded = np.zeros((m, blocks, size + length))
    padded[:, :, size:] = np.pad(x, ((0, 0), (0, blocks * length - n))).reshape(m, blocks, length)
    alone = _short_blocks(feedback, padded)
    # Answers to each of the S outputs before a block, on their own.
    unit = np.zeros((m, size, size + length))
    unit[:, :, :size] = np.eye(size)[::-1]
    answers = _short_blocks(feedback, unit)
    through = answers[:, :, : -size - 1 : -1].transpose(0, 2, 1)  # (models, output from the end, output before)
    starts = np.empty((m, blocks, size))
    for b in range(blocks):
        starts[:, b] = state
        state = np.einsum("mij,mj->mi", through, state) + alone[:, b, : -size - 1 : -1]
    y = alone[:, :, size:] + starts @ answers[:, :, size:]
    return np.concatenate((starts[:, 0, ::-1], y.reshape(m, -1)[:, :n]), axis=1)


# --- models --------------------------------------------------------------------------------------


def from_partials(r: np.ndarray) -> np.ndarray:
    """Coefficients phi of a stationary autoregression from its partial autocorrelations, row by row."""
    phi = np.zeros_like(r)
    for k in range(r.shape[1]):
        last = r[:, k : k + 1]
        phi[:, :k] -= last * phi[:, :k][:, ::-1]
        phi[:, k] = last[:, 0]
    return phi


def to_partials(phi: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of coefficients (order of each row given), pulled inside the bound where they are not."""
    out = np.zeros_like(phi)
    now = phi.copy()
    for k in range(phi.shape[1] - 1, -1, -1):
        here = order > k
        last = np.clip(np.where(here, now[:, k], 0.0), -0.97, 0.97)
        out[:, k] = last
        lower = (now[:, :k] + last[:, None] * now[:, :k][:, ::-1]) / (1.0 - last * last)[:, None]
        now[:, :k] = np.where(here[:, None], lower, now[:, :k])
    return out


class Models:
    """A stack of orders (p, q, with a constant or not) and where their fits stand."""

    def __init__(self, p: Sequence[int], q: Sequence[int], constant: Sequence[bool]) -> None:
        self.p, self.q, self.constant = np.array(p, int), np.array(q, int), np.array(constant, bool)
        self.n = len(self.p)
        self.np_, self.nq = int(self.p.max(initial=0)), int(self.q.max(initial=0))
        self.k = 1 + self.np_ + self.nq
        self.used = np.concatenate((
            self.constant[:, None], np.arange(self.np_) < self.p[:, None], np.arange(self.nq) < self.q[:, None]
        ), axis=1)
        #: Outputs that a block needs of the one before it.
        self.reach = max(1, 2 * self.nq + self.np_)
        self.x = np.zeros((self.n, self.k))
        self.trial = self.x.copy()
        self.damping = np.full(self.n, 1e-3)
        self.rss = np.full(self.n, np.inf)
        self.square = np.tile(np.eye(self.k), (self.n, 1, 1))
        self.slope = np.zeros((self.n, self.k))
        self.count = np.ones(self.n)

    def set_start(self, c: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> None:
        parts = np.concatenate((to_partials(phi, self.p), to_partials(-theta, self.q)), axis=1) / LIMIT
        self.trial = np.concatenate((c[:, None], parts / np.sqrt(1.0 - parts * parts)), axis=1) * self.used

    def coefficients(self, x: np.ndarray) -> np.ndarray:
        """c, phi, theta side by side."""
        r = np.where(self.used, LIMIT * x / np.sqrt(1.0 + x * x), 0.0)
        phi, theta = from_partials(r[:, 1 : 1 + self.np_]), -from_partials(r[:, 1 + self.np_ :])
        return np.concatenate((np.where(self.used, x, 0.0)[:, :1], phi, theta), axis=1)

    def derivative(self, x: np.ndarray, h: float = 1e-5) -> np.ndarray:
        """(models, coefficient, parameter)."""
        columns = [
            (self.coefficients(x + h * u) - self.coefficients(x - h * u)) / (2.0 * h) for u in np.eye(self.k)
        ]
        return np.stack(columns, axis=2)

    def feedback(self, theta: np.ndarray) -> np.ndarray:
        """Coefficients of theta(B) squared, without the leading 1, in `reach` places."""
        whole = np.concatenate((np.ones((self.n, 1)), theta), axis=1)
        out = np.zeros((self.n, max(2 * self.nq + 1, self.reach + 1)))
        for k in range(self.nq + 1):
            out[:, k : k + self.nq + 1] += whole[:, k : k + 1] * whole
        return out[:, 1 : 1 + self.reach]

    def part(self, rows: np.ndarray) -> "Models":
        """Orders of some rows only, in the same places."""
        out = Models(self.p[rows], self.q[rows], self.constant[rows])
        out.np_, out.nq, out.k, out.reach, out.used = self.np_, self.nq, self.k, self.reach, self.used[rows]
        return out

    def twice_filtered(self, values: np.ndarray, coefficients: np.ndarray, starts: np.ndarray | None) -> list[np.ndarray]:
        """z2 and o2 of a block of values, behind the `reach` outputs before it."""
        feedback = self.feedback(coefficients[:, 1 + self.np_ :])
        own = [None, None] if starts is None else [starts[:, 0], starts[:, 1]]
        ones = np.repeat(self.constant[:, None].astype(float), len(values), axis=1)
        return [
            filtered(feedback, np.broadcast_to(values, ones.shape), own[0]),
            filtered(feedback, ones, own[1]) if self.constant.any() else np.zeros((self.n, self.reach + len(values))),
        ]

    def errors(self, values: np.ndarray, coefficients: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """e (models, values) and its derivatives by coefficients (models, coefficients, values)."""
        n, back = len(values), self.reach
        c, phi, theta = np.split(coefficients, [1, 1 + self.np_], axis=1)
        z2, o2 = self.twice_filtered(values, coefficients, starts)

        def by_lags(y: np.ndarray, weights: np.ndarray, sign: float, extra: int) -> np.ndarray:
            """y[t] + sign * sum(weights[k] y[t-1-k]) for the n values and `extra` places before them."""
            out = y[:, back - extra : back + n].copy()
            for k in range(weights.shape[1]):
                out += sign * weights[:, k : k + 1] * y[:, back - extra - 1 - k : back + n - 1 - k]
            return out

        z1, o1 = by_lags(z2, theta, 1.0, self.np_), by_lags(o2, theta, 1.0, 0)
        e = z1[:, self.np_ :] - c * o1
        slopes = np.zeros((self.n, self.k, n))
        slopes[:, 0] = -o1
        for i in range(self.np_):
            past = z1[:, self.np_ - 1 - i : self.np_ - 1 - i + n]
            e -= phi[:, i : i + 1] * past
            slopes[:, 1 + i] = -past
        again = by_lags(z2, phi, -1.0, self.nq) - c * o2[:, back - self.nq : back + n]
        for k in range(self.nq):
            slopes[:, 1 + self.np_ + k] = -again[:, self.nq - 1 - k : self.nq - 1 - k + n]
        return e, slopes * self.used[:, :, None]

    def sums(self, values: np.ndarray, skipped: int, starts: np.ndarray | None = None) -> np.ndarray:
        """Sums over a block, its first `skipped` values left out: squares of e, slopes with e, slopes with slopes.

        Settled fits have none: they stay where they are.
        """
        coefficients = self.coefficients(self.trial)
        out = np.full((self.n, 1 + self.k + self.k * self.k), np.nan)
        todo = np.flatnonzero(~self.settled | np.isinf(self.rss))
        step = max(1, AT_ONCE // max(1, len(values) * (self.k + 1)))
        for at in range(0, len(todo), step):
            rows = todo[at : at + step]
            some = self.part(rows)
            e, slopes = some.errors(values, coefficients[rows], None if starts is None else starts[rows])
            e, slopes = e[:, skipped:], slopes[:, :, skipped:]
            out[rows] = np.concatenate((
                (e * e).sum(axis=1)[:, None], np.einsum("mkt,mt->mk", slopes, e),
                (slopes @ slopes.transpose(0, 2, 1)).reshape(some.n, -1),
            ), axis=1)
        return out

    def step(self, sums: np.ndarray, count: np.ndarray | float) -> None:
        """Take the trial over where it is better, and set out for the next one."""
        self.count = np.broadcast_to(np.asarray(count, float), (self.n,)).copy()
        fresh = np.isfinite(sums).all(axis=1)
        sums = np.where(fresh[:, None], sums, 0.0)
        by_coefficient = self.derivative(self.trial)
        slope = np.einsum("mki,mk->mi", by_coefficient, sums[:, 1 : 1 + self.k]) * self.used
        square = sums[:, 1 + self.k :].reshape(self.n, self.k, self.k)
        square = np.einsum("mki,mkl,mlj->mij", by_coefficient, square, by_coefficient)
        open_, begun = ~self.settled, np.isfinite(self.rss)
        better = fresh & (sums[:, 0] <= self.rss)
        move = np.where(begun[:, None], self.trial - self.x, 0.0)
        aim = np.where(begun[:, None], self.slope, 0.0)
        expected = -2.0 * (aim * move).sum(axis=1) - np.einsum("mi,mij,mj->m", move, self.square, move)
        gained = np.where(begun, self.rss, 0.0) - sums[:, 0]
        ratio = np.clip(gained / np.where(expected > 0.0, expected, np.inf), 0.0, 1.0)
        change = np.where(better, np.maximum(1.0 / 3.0, 1.0 - (2.0 * ratio - 1.0) ** 3), 4.0)
        self.damping = np.clip(self.damping * np.where(open_ & begun, change, 1.0), 1e-12, STUCK)
        self.x[better], self.rss[better] = self.trial[better], sums[better, 0]
        self.slope[better], self.square[better] = slope[better], square[better]
        ahead = self.x - self.solved(self.damping)
        ahead[:, 1:] = np.clip(ahead[:, 1:], -EDGE, EDGE)
        self.trial = np.where(self.settled[:, None], self.x, ahead)

    @property
    def free(self) -> np.ndarray:
        """Parameters in use but for those that are held by the bound."""
        return self.used & ~((np.abs(self.x) >= EDGE) & (self.slope * self.x < 0.0) & (np.arange(self.k) > 0))

    def solved(self, damping: np.ndarray) -> np.ndarray:
        """The damped normal equations, in units of the parameters' own sums of squares."""
        at = np.arange(self.k)
        free = self.free
        unit = np.sqrt(np.maximum(np.where(free, self.square[:, at, at], 1.0), 1e-300))
        scaled = np.where(free[:, :, None] & free[:, None, :], self.square, 0.0) / unit[:, :, None] / unit[:, None, :]
        scaled[:, at, at] = 1.0 + damping[:, None]
        begun = np.isfinite(self.rss)
        scaled[~begun] = np.eye(self.k)
        aim = np.where(free & begun[:, None], self.slope, 0.0) / unit
        return np.linalg.solve(scaled, aim[:, :, None])[:, :, 0] / unit

    @property
    def to_gain(self) -> np.ndarray:
        """The part of its squared error that each fit could still lose by a step, were errors linear in parameters.

        That is the squared cosine of the angle between the errors and their slopes, free of any unit.
        """
        begun = np.isfinite(self.rss)
        aim = np.where(self.free & begun[:, None], self.slope, 0.0)
        gain = (aim * self.solved(np.full(self.n, 1e-12))).sum(axis=1)
        return np.where(begun, gain / np.where(begun & (self.rss > 0.0), self.rss, 1.0), np.inf)

    @property
    def settled(self) -> np.ndarray:
        return (self.to_gain < FLAT / 1e4) | (self.damping >= STUCK)

    def packed(self) -> list[float]:
        """Where the fits stand, as numbers."""
        parts = [self.x, self.trial, self.slope, self.square.reshape(self.n, -1)]
        parts += [v[:, None] for v in (self.damping, self.rss, self.count)]
        return np.concatenate(parts, axis=1).ravel().tolist()

    def unpack(self, numbers: Sequence[float]) -> "Models":
        k = self.k
        flat = np.array(numbers, float).reshape(self.n, 3 * k + k * k + 3)
        self.x, self.trial, self.slope = (flat[:, i * k : (i + 1) * k].copy() for i in range(3))
        self.square = flat[:, 3 * k : 3 * k + k * k].reshape(self.n, k, k).copy()
        self.damping, self.rss, self.count = (flat[:, 3 * k + k * k + i].copy() for i in range(3))
        return self


def models_of(orders: Sequence, d: int) -> Models:
    """Models of rows with p and q; constants for d = 0 only."""
    return Models([o["p"] for o in orders], [o["q"] for o in orders], [d == 0] * len(orders))


def started(orders: Sequence, d: int, mean: float, std: float) -> Models:
    """Models that set out from given coefficients, in units of the scaled series."""
    out = models_of(orders, d)
    phi, theta, c = np.zeros((out.n, out.np_)), np.zeros((out.n, out.nq)), np.zeros(out.n)
    for i, o in enumerate(orders):
        phi[i, : o["p"]], theta[i, : o["q"]] = o["ar"], o["ma"]
        c[i] = (o["intercept"] - mean * (1.0 - np.sum(o["ar"]))) / std if d == 0 else 0.0
    out.given = np.concatenate((c[:, None], phi, theta), axis=1)
    out.set_start(c, phi, theta)
    return out


# --- on Spark ------------------------------------------------------------------------------------


def blocks_of(rows: DataFrame, keys: Sequence[str], position: str = "bin", block: int = BLOCK) -> DataFrame:
    """keys, d, mean, std, block, at (first position), values: the scaled differences in arrays of at most `block`."""
    home = F.floor(F.col(position) / F.lit(block)).alias("block")
    entry = F.struct(F.col(position).cast("long").alias("at"), F.col("z").alias("z"))
    return rows.groupBy(*keys, "d", home).agg(
        F.sort_array(F.collect_list(entry)).alias("_rows"), F.first("_mean").alias("mean"), F.first("_std").alias("std")
    ).select(*keys, "d", "mean", "std", "block", F.col("_rows")[0]["at"].alias("at"), F.col("_rows.z").alias("values"))


def _orders(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The fits of each (series, d) as one list, in the order of p and q."""
    fields = ["p", "q", "n_obs", "intercept", "ar", "ma"]
    usable = fits.filter("ar is not null and ma is not null and intercept is not null")
    return usable.groupBy(*keys, "d").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("orders"))


def _restored(row: dict, current: bool) -> tuple[Models, np.ndarray]:
    """Models of a row, with the coefficients they were given or those of the trial that they stand at."""
    models = started(row["orders"], row["d"], row["mean"], row["std"])
    if not current:
        return models, models.given
    models.unpack(row["state"])
    return models, models.coefficients(models.trial)


def _numbers(fields: Sequence[T.StructField], *names: str) -> T.StructType:
    """The fields and arrays of numbers."""
    return T.StructType([*fields, *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)])


def _with_starts(work: DataFrame, keys: Sequence[str], current: bool) -> DataFrame:
    """Blocks with the outputs before them: maps of all blocks side by side, then their products along each series.

    Of a series one narrow row a block meets in one task.
    """
    by = [*keys, "d"]
    kinds = [*(work.schema[k] for k in by), T.StructField("block", T.LongType())]

    def ends_alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The outputs that blocks end with when nothing was before them."""
        for pdf in batches:
            ends = []
            for row in pdf.to_dict("records"):
                models, coefficients = _restored(row, current)
                y = models.twice_filtered(np.asarray(row["values"], float), coefficients, None)
                ends.append(np.stack([v[:, : -models.reach - 1 : -1] for v in y], axis=1).ravel().tolist())
            yield pdf[[*by, "block"]].assign(length=[len(v) for v in pdf["values"]], ends=ends)

    ends = work.mapInPandas(ends_alone, _numbers([*kinds, T.StructField("length", T.LongType())], "ends"))
    first = work.groupBy(*by).agg(F.min("block").alias("block"))
    facts = ["orders", "mean", "std", *(["state"] if current else [])]
    heads = join_on(first, work.select(*by, "block", *facts), [*by, "block"])
    chain = join_on(ends, heads, [*by, "block"], "left")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        models, coefficients = _restored(pdf.iloc[0].to_dict(), current)
        feedback = models.feedback(coefficients[:, 1 + models.np_ :])
        state = np.zeros((models.n, 2, models.reach))
        out, known = [], {}
        for length, end in zip(pdf["length"], pdf["ends"]):
            out.append(state.ravel().tolist())
            if length not in known:
                known[length] = block_map(feedback, int(length))
            state = np.einsum("mij,mcj->mci", known[length], state) + np.asarray(end, float).reshape(state.shape)
        return pdf[[*by, "block"]].assign(starts=out)

    starts = chain.groupBy(*by).applyInPandas(products, _numbers(kinds, "starts"))
    return join_on(work, starts, [*by, "block"])


RESULT = ["n_obs", "rss", "mse", "intercept", "ar", "ma"]


def _results(row: dict, models: Models) -> list[tuple]:
    """p, q and results of the fits of one (series, d), NULL where the minimum was not reached."""
    out = []
    coefficients = models.coefficients(models.x)
    fine = models.to_gain < FLAT
    for i, order in enumerate(row["orders"]):
        p, q, n = int(order["p"]), int(order["q"]), int(order["n_obs"])
        if not fine[i]:
            out.append((p, q, n, *(None,) * 5))
            continue
        phi, theta = coefficients[i, 1 : 1 + p], coefficients[i, 1 + models.np_ : 1 + models.np_ + q]
        rss = float(models.rss[i]) * row["std"] * row["std"]
        start = coefficients[i, 0] * row["std"] + row["mean"] * (1.0 - phi.sum())
        out.append((p, q, n, rss, rss / n, float(start), phi.tolist(), theta.tolist()))
    return out


def _gathered(pdf: pd.DataFrame, by: Sequence[str], results: list[list[tuple]]) -> pd.DataFrame:
    """Results of the rows of pdf, one below the other."""
    out = pdf[[*by]].iloc[[i for i, r in enumerate(results) for _ in r]].reset_index(drop=True)
    flat = [x for r in results for x in r]
    for j, name in enumerate(["p", "q", *RESULT]):
        out[name] = pd.Series([x[j] for x in flat], dtype=object)
    return out


def _skipped(row: dict) -> int:
    """Values of a row's block before the sample, which is the last n_obs rows of the series."""
    return int(np.clip(row["first"] - row["at"], 0, len(row["values"])))


def css_fit(
    rows: DataFrame, starts: DataFrame, keys: Sequence[str], position: str = "bin", block: int = BLOCK,
    max_steps: int = MAX_STEPS,
) -> DataFrame:
    """The orders of `starts`, refitted by least squares of the models' own errors from the coefficients given there.

    rows as of innovations (z, _mean, _std), without gaps; the sample of a fit is the last n_obs rows of its series, as
    in `starts`. Returned are the columns of `starts`; rows without a fit there have none here, and a fit of which no
    minimum is found (more than FLAT of its squared error is still to gain) has NULL results.
    """
    by = [*keys, "d"]
    found = blocks_of(rows.filter("z is not null"), keys, position, block)
    ends = rows.groupBy(*by).agg(F.max(position).alias("_last"), F.min(position).alias("_first"))
    inside = F.floor(F.col("_last") / block) == F.floor(F.col("_first") / block)
    facts = join_on(_orders(starts, keys), ends, by).select(
        *by, "orders", (F.col("_last") + 1 - F.col("orders")[0]["n_obs"]).alias("first"), inside.alias("alone")
    )
    work = stored(join_on(found, facts, by), "css-blocks")
    schema = T.StructType([
        *(work.schema[k] for k in by), *(T.StructField(n, T.IntegerType()) for n in ("p", "q")), T.StructField("n_obs", T.LongType()),
        *(T.StructField(n, T.DoubleType()) for n in ("rss", "mse", "intercept")),
        *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("ar", "ma")),
    ])

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                values, skipped = np.asarray(row["values"], float), _skipped(row)
                models = started(row["orders"], row["d"], row["mean"], row["std"])
                for _ in range(max_steps):
                    models.step(models.sums(values, skipped), len(values) - skipped)
                    if models.settled.all():
                        break
                out.append(_results(row, models))
            yield _gathered(pdf, by, out)

    # One row a task at a time: the work of a row is long, its bytes are few.
    short = work.filter("alone").repartition(task_count(work), *by).mapInPandas(alone, schema)
    long = work.filter("not alone").drop("alone")
    refined = short if long.isEmpty() else short.unionByName(_fit_long(long, keys, max_steps, schema))
    every = starts.select(*(c for c in starts.columns if c not in RESULT), F.col("n_obs").alias("_n"))
    joined = join_on(every, refined, [*by, "p", "q"], "left").withColumn("n_obs", F.coalesce("n_obs", "_n"))
    return joined.select(*starts.columns)


def _fit_long(long: DataFrame, keys: Sequence[str], max_steps: int, schema: T.StructType) -> DataFrame:
    """Fits of series of several blocks: each step reads all blocks twice and adds up their sums."""
    by = [*keys, "d"]
    kinds = [long.schema[k] for k in by]
    facts = stored(long.groupBy(*by).agg(*(F.first(c).alias(c) for c in ("orders", "mean", "std"))), "css-orders")

    def first_state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            models = [started(r["orders"], r["d"], r["mean"], r["std"]) for r in pdf.to_dict("records")]
            yield pdf[by].assign(state=[m.packed() for m in models])

    def block_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, counts = [], []
            for row in pdf.to_dict("records"):
                models, _ = _restored(row, True)
                starts = np.asarray(row["starts"], float).reshape(models.n, 2, models.reach)
                out.append(models.sums(np.asarray(row["values"], float), _skipped(row), starts).ravel().tolist())
                counts.append(len(row["values"]) - _skipped(row))
            yield pdf[by].assign(used=counts, sums=out)

    def stepped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            after, unsettled = [], []
            for row in pdf.to_dict("records"):
                models, _ = _restored(row, True)
                models.step(np.asarray(row["sums"], float).reshape(models.n, -1), row["used"])
                after.append(models.packed())
                unsettled.append(not models.settled.all())
            yield pdf[by].assign(unsettled=unsettled, state=after)

    def results(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _gathered(pdf, by, [_results(r, _restored(r, True)[0]) for r in pdf.to_dict("records")])

    # Tables rather than checkpoints: a checkpoint hands on what its plan knew, which grows with every step.
    states, done = stored(facts.mapInPandas(first_state, _numbers(kinds, "state")), "css-state"), None
    for _ in range(max_steps):
        placed = _with_starts(join_on(long, states, by), keys, True)
        parts = placed.mapInPandas(block_sums, _numbers([*kinds, T.StructField("used", T.LongType())], "sums"))
        total = parts.select(*by, "used", F.posexplode("sums").alias("i", "x")).groupBy(*by, "i").agg(
            F.sum("x").alias("x"), F.sum("used").alias("used")
        ).groupBy(*by).agg(
            F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_s"), F.first("used").alias("used")
        ).select(*by, "used", F.col("_s.x").alias("sums"))
        now = join_on(join_on(facts, states, by), total, by)
        now = now.mapInPandas(stepped, _numbers([*kinds, T.StructField("unsettled", T.BooleanType())], "state"))
        now = stored(now, "css-state")
        closed = now.filter("not unsettled").drop("unsettled")
        done = closed if done is None else done.unionByName(closed)
        states = now.filter("unsettled").drop("unsettled")
        if states.isEmpty():
            break
    else:
        done = done.unionByName(states)
    return join_on(facts, done, by).mapInPandas(results, schema)


def own_errors(
    rows: DataFrame, fits: DataFrame, keys: Sequence[str], position: str = "bin", block: int = BLOCK
) -> DataFrame:
    """The rows of each fitted (series, d) with `e`, the error of the fit's own recursion, in units of the scaled series.

    fits: at most one order for each series and d, with intercept, ar and ma; any coefficients, fitted or given.
    """
    by = [*keys, "d"]
    chosen = _orders(fits.withColumn("n_obs", F.coalesce("n_obs", F.lit(0).cast("long"))), keys)
    found = join_on(blocks_of(rows.filter("z is not null"), keys, position, block), chosen, by)
    placed = _with_starts(stored(found, "css-blocks"), keys, False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                models, coefficients = _restored(row, False)
                starts = np.asarray(row["starts"], float).reshape(models.n, 2, models.reach)
                out.append(models.errors(np.asarray(row["values"], float), coefficients, starts)[0][0].tolist())
            yield pdf[[*by, "at"]].assign(e=out)

    schema = _numbers([*(rows.schema[k] for k in by), T.StructField("at", T.LongType())], "e")
    errors = placed.mapInPandas(run, schema).select(*by, "at", F.posexplode("e").alias("_i", "e"))
    errors = errors.select(*by, (F.col("at") + F.col("_i")).alias(position), "e")
    return join_on(rows.drop("e"), errors, [*by, position]).select(*rows.columns)


def own_fitted(
    rows: DataFrame, fits: DataFrame, keys: Sequence[str], value: str, position: str = "bin", block: int = BLOCK
) -> DataFrame:
    """In-sample one-step predictions of one chosen fit per series by its own recursion, in units of the series.

    Rows that lack one of the p values which the prediction reads have none.
    """
    by = [*keys, "d"]
    errors = own_errors(rows, fits, keys, position, block)
    placed = join_on(errors, fits.select(*by, "p", "q"), by).filter(F.col(position) >= F.col("d") + F.col("p"))
    return placed.select(*keys, "p", "d", "q", position, value, (F.col(value) - F.col("e") * F.col("_std")).alias("fitted"))


def with_own_errors(
    rows: DataFrame, fits: DataFrame, keys: Sequence[str], position: str = "bin", block: int = BLOCK
) -> DataFrame:
    """rows with the errors of the fits in place of those of the long autoregression, wherever there is a fit."""
    by = [*keys, "d"]
    own = own_errors(rows, fits, keys, position, block)
    fitted = fits.filter("ar is not null and ma is not null and intercept is not null").select(*by, F.lit(True).alias("_own"))
    rest = join_on(rows, fitted, by, "left").filter("_own is null").drop("_own")
    return own.unionByName(rest)
