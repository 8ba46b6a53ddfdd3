"""Shared subqueries of the check SQL."""

from __future__ import annotations

import math
import re

FREQ = repr(2.0 * math.pi / 86_400.0)
ROOT2 = repr(math.sqrt(2.0))


def _bars(unit: str) -> str:
    return f"""
        SELECT event_type AS instrument, CAST(epoch(date_trunc('{unit}', ts)) AS BIGINT) AS timestamp,
               first(value ORDER BY ts, event_id) AS o, min(value) AS l, max(value) AS h,
               last(value ORDER BY ts, event_id) AS c, CAST(count(*) AS BIGINT) AS volume
        FROM events GROUP BY 1, 2"""


def _local(unit: str) -> str:
    return f"""
        SELECT *, isodow(datetime_tz) - 1 AS weekday_tz, hour(datetime_tz) AS hour_tz
        FROM (SELECT *, make_timestamp(timestamp * 1000000) AT TIME ZONE 'UTC'
                        AT TIME ZONE 'US/Eastern' AS datetime_tz FROM bars_{unit})"""


def _aligned(unit: str) -> str:
    return f"""
        SELECT instrument, timestamp, datetime_tz, weekday_tz, hour_tz, weekday_shifted, volume,
               (l + h + c) / 3 AS lhc,
               CASE WHEN weekday_shifted - weekday_tz > 0
                    THEN CAST(datetime_tz AS DATE) + CAST(weekday_shifted - weekday_tz AS INTEGER)
                    WHEN weekday_shifted - weekday_tz = -6 THEN CAST(datetime_tz AS DATE) + 1
                    ELSE CAST(datetime_tz AS DATE) END AS session_date
        FROM local_{unit} LEFT JOIN lookup USING (weekday_tz, hour_tz)"""


def _signals(unit: str) -> str:
    return f"""
        SELECT instrument, session_date, timestamp, lhc AS price, volume,
               sin(timestamp * CAST({FREQ} AS DOUBLE)) * CAST({ROOT2} AS DOUBLE) AS sine,
               cos(timestamp * CAST({FREQ} AS DOUBLE)) * CAST({ROOT2} AS DOUBLE) AS cosine
        FROM (SELECT *, count(lhc) OVER d AS np, count(volume) OVER d AS nv, count(timestamp) OVER d AS nt
              FROM aligned_{unit} WINDOW d AS (PARTITION BY instrument, session_date))
        WHERE np = nv AND np = nt"""


def _placed(unit: str, divisor: int) -> str:
    return f"""
        SELECT instrument, session_date, slot, arg_max(price, timestamp) AS price,
               arg_max(volume, timestamp) AS volume, arg_max(sine, timestamp) AS sine,
               arg_max(cosine, timestamp) AS cosine
        FROM (SELECT *, CAST(sum(gap) OVER (PARTITION BY instrument, session_date ORDER BY timestamp
                             ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS slot
              FROM (SELECT *, trunc((lead(timestamp) OVER (PARTITION BY instrument, session_date
                                     ORDER BY timestamp) - timestamp) / {divisor}.0) AS gap
                    FROM signals_{unit}))
        WHERE gap IS NOT NULL AND slot >= 0
        GROUP BY 1, 2, 3"""


def _placed_own(unit: str, divisor: int) -> str:
    return f"""
        SELECT instrument, session_date, slot, arg_max(price, timestamp) AS price
        FROM (SELECT *, CAST(floor((timestamp - min(timestamp) OVER (PARTITION BY instrument,
                             session_date)) / {divisor}.0) AS BIGINT) AS slot
              FROM signals_{unit})
        GROUP BY 1, 2, 3"""


def _grid(unit: str) -> str:
    return f"""
        SELECT s.instrument, s.session_date, s.slot, p.price, p.volume, p.sine, p.cosine
        FROM (SELECT instrument, session_date, unnest(range(0, max(slot) + 1)) AS slot
              FROM placed_{unit} GROUP BY 1, 2) s
        LEFT JOIN placed_{unit} p USING (instrument, session_date, slot)"""


def linear_fill(source: str, keys: str, position: str, values: list[str], keep: str = "") -> str:
    """Gap filling by position with held edges; all values are missing together."""
    first = values[0]
    inner = ", ".join(
        f"last_value({v} IGNORE NULLS) OVER b AS b_{v}, first_value({v} IGNORE NULLS) OVER f AS f_{v}"
        for v in values
    )
    outer = ", ".join(
        f"CASE WHEN bp IS NULL THEN f_{v} WHEN fp IS NULL OR fp = bp THEN b_{v} "
        f"ELSE b_{v} + (f_{v} - b_{v}) * ({position} - bp) / (fp - bp) END AS {v}"
        for v in values
    )
    known = f"CASE WHEN {first} IS NOT NULL THEN {position} END"
    return f"""
        SELECT {keys}, {position}, {keep} {outer}
        FROM (SELECT *, last_value({known} IGNORE NULLS) OVER b AS bp,
                     first_value({known} IGNORE NULLS) OVER f AS fp, {inner}
              FROM {source}
              WINDOW b AS (PARTITION BY {keys} ORDER BY {position}
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     f AS (PARTITION BY {keys} ORDER BY {position}
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _samples(unit: str, n_back: int, n_forward: int) -> str:
    return f"""
        SELECT instrument, session_date, unnest(range({n_back}, n - {n_back} - {n_forward})) AS sample_slot
        FROM (SELECT instrument, session_date, CAST(count(*) AS BIGINT) AS n FROM filled_{unit}
              GROUP BY 1, 2)
        WHERE n > {2 * n_back + n_forward}"""


def _back(unit: str, n_back: int) -> str:
    """Look-back values in long form; extra is the change from step to step, 0 at the first."""
    return f"""
        SELECT instrument, session_date, sample_slot, slot - sample_slot + {n_back} AS step,
               price, volume, sine, cosine,
               price - coalesce(lag(price) OVER (PARTITION BY instrument, session_date, sample_slot
                                                 ORDER BY slot), price) AS extra
        FROM samples_{unit} JOIN filled_{unit} USING (instrument, session_date)
        WHERE slot >= sample_slot - {n_back} AND slot < sample_slot"""


def _ahead(unit: str, n_forward: int) -> str:
    return f"""
        SELECT instrument, session_date, sample_slot, slot - sample_slot AS step, price
        FROM samples_{unit} JOIN filled_{unit} USING (instrument, session_date)
        WHERE slot >= sample_slot AND slot < sample_slot + {n_forward}"""


def spread(x: str) -> str:
    """Population deviation, exactly 0 for equal values."""
    return f"CASE WHEN min({x}) = max({x}) THEN 0 ELSE stddev_pop({x}) END"


def _moments(unit: str) -> str:
    parts = ", ".join(
        f"avg({x}) AS {x}_mean, {spread(x)} AS {x}_std" for x in ("price", "volume", "extra")
    )
    return f"SELECT instrument, session_date, sample_slot, {parts} FROM back_{unit} GROUP BY 1, 2, 3"


def _targets(unit: str) -> str:
    return f"""
        SELECT instrument, session_date, sample_slot, min(price) AS y_min, max(price) AS y_max,
               avg(price) AS path_mean, {spread('price')} AS path_std
        FROM ahead_{unit} GROUP BY 1, 2, 3"""


def _unit(unit: str, divisor: int, n_back: int, n_forward: int) -> dict[str, str]:
    return {
        f"bars_{unit}": _bars(unit),
        f"local_{unit}": _local(unit),
        f"aligned_{unit}": _aligned(unit),
        f"signals_{unit}": _signals(unit),
        f"placed_{unit}": _placed(unit, divisor),
        f"placedown_{unit}": _placed_own(unit, divisor),
        f"grid_{unit}": _grid(unit),
        f"filled_{unit}": linear_fill(
            f"grid_{unit}", "instrument, session_date", "slot", ["price", "volume", "sine", "cosine"]
        ),
        f"samples_{unit}": _samples(unit, n_back, n_forward),
        f"back_{unit}": _back(unit, n_back),
        f"ahead_{unit}": _ahead(unit, n_forward),
        f"moments_{unit}": _moments(unit),
        f"targets_{unit}": _targets(unit),
    }


PAGE = "CAST(floor(o_orderkey / 1000.0) AS BIGINT)"

SHARED: dict[str, str] = {
    "lookup": """
        SELECT w AS weekday_tz, h AS hour_tz, CASE WHEN h >= 17 THEN (w + 1) % 7 ELSE w END AS weekday_shifted
        FROM range(7) a(w), range(24) b(h)""",
    **_unit("hour", 3600, 6, 3),
    **_unit("minute", 60, 30, 15),
    "spot_records": """
        SELECT o_orderpriority AS series, o_orderdate AS "Timestamp",
               CAST(o_totalprice AS VARCHAR) AS "SpotPrice", o_totalprice AS price, o_orderkey
        FROM orders""",
    "page_copies": f"""
        SELECT series, "Timestamp", "SpotPrice", price, {PAGE} AS page FROM spot_records
        UNION ALL
        SELECT series, "Timestamp", "SpotPrice", price, {PAGE} + 1 FROM spot_records
        WHERE o_orderkey % 1000 >= 900""",
    "spot_means": """
        SELECT series, CAST(floor(epoch("Timestamp") / 86400) AS BIGINT) AS day, avg(price) AS spot_price
        FROM spot_records GROUP BY 1, 2""",
    "spot_daily": """
        SELECT s.series, make_timestamp(s.day * 86400000000) AS "Timestamp", s.day - s.first_day AS bin,
               m.spot_price
        FROM (SELECT series, min(day) AS first_day, unnest(range(min(day), max(day) + 1)) AS day
              FROM spot_means GROUP BY 1) s
        LEFT JOIN spot_means m USING (series, day)""",
    "spot_series": linear_fill("spot_daily", "series", "bin", ["spot_price"], keep='"Timestamp",'),
    "spot_split": """
        SELECT *, CASE WHEN bin < round_even(CAST(0.9 AS DOUBLE) * n_rows, 0) THEN 'train' ELSE 'test' END
                  AS split
        FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n_rows FROM spot_series)""",
    "spot_train": "SELECT series, bin, spot_price FROM spot_split WHERE split = 'train'",
    "acf_mean": "SELECT *, spot_price - avg(spot_price) OVER (PARTITION BY series) AS x FROM spot_train",
    "acf_pairs": """
        SELECT a.series, k.lag, sum(a.x * b.x) AS s
        FROM acf_mean a, (SELECT unnest(range(0, 11)) AS lag) k, acf_mean b
        WHERE b.series = a.series AND b.bin = a.bin - k.lag GROUP BY 1, 2""",
    "acf_long": """
        SELECT p.series, p.lag, p.s / z.s AS r, n.n
        FROM acf_pairs p JOIN acf_pairs z ON z.series = p.series AND z.lag = 0
        JOIN (SELECT series, count(*) AS n FROM spot_train GROUP BY 1) n ON n.series = p.series""",
    "acf_lists": "SELECT series, any_value(n) AS n, list(r ORDER BY lag) AS r FROM acf_long GROUP BY 1",
    "levinson": """
        SELECT series, n, r, CAST(1 AS BIGINT) AS k, [r[2]] AS phi, r[2] AS last FROM acf_lists
        UNION ALL
        SELECT series, n, r, k + 1,
               list_append([phi[j] - a * phi[len(phi) + 1 - j] for j in range(1, len(phi) + 1)], a), a
        FROM (SELECT *, (r[k + 2] - list_sum([phi[j] * r[k + 2 - j] for j in range(1, len(phi) + 1)]))
                        / (1 - list_sum([phi[j] * r[j + 1] for j in range(1, len(phi) + 1)])) AS a
              FROM levinson WHERE k < 10)""",
    "lag_diffs": """
        SELECT series, bin, d, diff FROM (
            SELECT series, bin, d, CASE WHEN d = 0 THEN spot_price
                   ELSE spot_price - lead(spot_price, d) OVER (PARTITION BY series, d ORDER BY bin) END AS diff
            FROM (SELECT *, unnest(range(0, 6)) AS d FROM spot_train))
        WHERE diff IS NOT NULL""",
    "df_sums": """
        SELECT series, d, CAST(count(*) AS BIGINT) AS n_obs, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx,
               regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy
        FROM (SELECT series, d, diff - lag(diff) OVER w AS y, lag(diff) OVER w AS x FROM lag_diffs
              WINDOW w AS (PARTITION BY series, d ORDER BY bin))
        WHERE x IS NOT NULL GROUP BY 1, 2""",
    "df_tests": """
        SELECT series, d, n_obs, slope / sqrt((syy - sxy * sxy / sxx) / ((n_obs - 2) * sxx)) AS stat
        FROM df_sums""",
    "df_verdict": """
        SELECT *, CASE WHEN stat < -18.83 THEN '-infinity'::DOUBLE WHEN stat > 2.74 THEN 'infinity'::DOUBLE
                  WHEN stat <= -1.61 THEN 2.1659 + 1.4412 * stat + 0.038269 * stat * stat
                  ELSE 1.7339 + 0.93202 * stat - 0.12745 * stat * stat - 0.010368 * stat * stat * stat END
                  AS p_quantile
        FROM (SELECT * FROM df_tests)""",
    "ar1_diffs": """
        SELECT series, bin, spot_price, 0 AS d, spot_price AS w FROM spot_train
        UNION ALL
        SELECT * FROM (SELECT series, bin, spot_price, 1 AS d,
                              spot_price - lag(spot_price) OVER (PARTITION BY series ORDER BY bin) AS w
                       FROM spot_train) WHERE w IS NOT NULL
        UNION ALL
        SELECT * FROM (SELECT series, bin, spot_price, 2 AS d,
                              spot_price - 2 * lag(spot_price) OVER (PARTITION BY series ORDER BY bin)
                              + lag(spot_price, 2) OVER (PARTITION BY series ORDER BY bin) AS w
                       FROM spot_train) WHERE w IS NOT NULL""",
    "ar1_rows": """
        SELECT * FROM (SELECT *, lag(w) OVER (PARTITION BY series, d ORDER BY bin) AS v FROM ar1_diffs)
        WHERE v IS NOT NULL""",
    "ar1_fits": """
        SELECT series, d, CAST(count(*) AS BIGINT) AS n_obs,
               CASE WHEN d = 0 THEN regr_intercept(w, v) ELSE 0.0 END AS intercept,
               CASE WHEN d = 0 THEN regr_slope(w, v) ELSE sum(w * v) / sum(v * v) END AS slope,
               CASE WHEN d = 0 THEN regr_syy(w, v) - regr_sxy(w, v) * regr_sxy(w, v) / regr_sxx(w, v)
                    ELSE sum(w * w) - sum(w * v) * sum(w * v) / sum(v * v) END AS rss
        FROM ar1_rows GROUP BY 1, 2""",
    "ar1_fitted": """
        SELECT series, d, bin, spot_price, spot_price - (w - (intercept + slope * v)) AS fitted
        FROM ar1_rows JOIN ar1_fits USING (series, d)""",
    "ar1_forecast": """
        SELECT series, d, bin_end + k AS bin, k AS step,
               CASE WHEN d = 0 THEN mu + power(slope, k) * (w_end - mu)
                    ELSE y_end + mu * k + (w_end - mu) * slope * (1 - power(slope, k)) / (1 - slope) END
               AS forecast
        FROM (SELECT *, intercept / (1 - slope) AS mu, unnest(range(1, h + 1)) AS k
              FROM (SELECT series, d, max(bin) AS bin_end, arg_max(w, bin) AS w_end,
                           arg_max(spot_price, bin) AS y_end FROM ar1_diffs WHERE d < 2 GROUP BY 1, 2)
              JOIN ar1_fits USING (series, d)
              JOIN (SELECT series, count(*) AS h FROM spot_split WHERE split = 'test' GROUP BY 1)
                   USING (series))""",
    # ARIMA with at most one lag of either kind, two-step regression in closed form; no constant for d = 1.
    "small_rows": """
        SELECT * FROM (SELECT *, lag(e) OVER (PARTITION BY series, d ORDER BY bin) AS e1
                       FROM (SELECT series, d, bin, spot_price, w, v, w - (intercept + slope * v) AS e
                             FROM ar1_rows JOIN ar1_fits USING (series, d) WHERE d < 2))
        WHERE e1 IS NOT NULL""",
    "small_sums": """
        SELECT series, d, mw, mv, me, CAST(count(*) AS BIGINT) AS n_obs,
               sum((w - mw) * (w - mw)) AS yy, sum((v - mv) * (v - mv)) AS vv, sum((e1 - me) * (e1 - me)) AS ee,
               sum((w - mw) * (v - mv)) AS vy, sum((w - mw) * (e1 - me)) AS ey, sum((v - mv) * (e1 - me)) AS ve
        FROM small_rows JOIN (SELECT series, d, CASE WHEN d = 0 THEN avg(w) ELSE 0.0 END AS mw,
                                     CASE WHEN d = 0 THEN avg(v) ELSE 0.0 END AS mv,
                                     CASE WHEN d = 0 THEN avg(e1) ELSE 0.0 END AS me
                              FROM small_rows GROUP BY 1, 2) USING (series, d)
        GROUP BY series, d, mw, mv, me""",
    "small_fits": """
        SELECT series, p, d, q, n_obs, a, b, mw - a * mv - b * me AS c, (yy - a * vy - b * ey) / n_obs AS mse
        FROM (SELECT *, p, q, CASE WHEN p = 0 THEN 0.0 WHEN q = 0 THEN vy / vv
                                   ELSE (vy * ee - ey * ve) / (vv * ee - ve * ve) END AS a,
                     CASE WHEN q = 0 THEN 0.0 WHEN p = 0 THEN ey / ee
                          ELSE (ey * vv - vy * ve) / (vv * ee - ve * ve) END AS b
              FROM small_sums, range(2) x(p), range(2) y(q))""",
    # Pages by the token that they answer, walked from page to page; some were lost, and some lead back.
    "link_rows": """
        SELECT DISTINCT series, CASE WHEN page > 0 THEN 'page-' || page ELSE '' END AS token,
               'page-' || CASE WHEN page % 11 = 10 THEN page - 4 ELSE page + 1 END AS next_token
        FROM page_copies WHERE page % 7 <> 3""",
    "link_ways": """
        SELECT series, token, token AS last, next_token, [token] AS seen, false AS cycle FROM link_rows
        UNION ALL
        SELECT w.series, w.token, l.token, l.next_token, list_append(w.seen, l.token), list_contains(w.seen, l.token)
        FROM link_ways w JOIN link_rows l ON l.series = w.series AND l.token = w.next_token WHERE NOT w.cycle""",
    "link_ends": """
        SELECT series, token, arg_max(last, len(seen)) AS last, arg_max(next_token, len(seen)) AS next_token,
               arg_max(seen, len(seen)) AS seen, bool_or(cycle) AS cycle
        FROM link_ways GROUP BY 1, 2""",
    "link_chains": """
        SELECT series, nullif(token, '') AS token, cycle, CASE WHEN NOT cycle THEN len(seen) - 1 END AS steps,
               CASE WHEN NOT cycle THEN next_token END AS missing,
               CASE WHEN cycle THEN list_min(seen[list_position(seen, last) + 1 :]) ELSE nullif(last, '') END AS chain
        FROM link_ends""",
    # Errors of the (1,1,1) model by its own recursion, one value after the other; nothing is before the first.
    "own_lists": "SELECT series, min(bin) AS bin0, list(w ORDER BY bin) AS ws FROM ar1_diffs WHERE d = 1 GROUP BY 1",
    "own_errors": """
        SELECT series, bin0, ws, a, b, CAST(1 AS BIGINT) AS k, ws[1] AS e
        FROM own_lists JOIN (SELECT series, a, b FROM small_fits WHERE p = 1 AND d = 1 AND q = 1) USING (series)
        UNION ALL
        SELECT series, bin0, ws, a, b, k + 1, ws[k + 1] - a * ws[k] - b * e FROM own_errors WHERE k < len(ws)""",
}

RECURSIVE = {"levinson", "link_ways", "own_errors"}


def with_shared(select: str) -> str:
    """Put the shared subqueries that the statement names, directly or not, in front of it."""
    order: list[str] = []

    def visit(text: str, inside: str | None) -> None:
        for name, body in SHARED.items():
            if name != inside and name not in order and re.search(rf"\b{name}\b", text):
                visit(body, name)
                if name not in order:
                    order.append(name)

    visit(select, None)
    if not order:
        return select
    word = "WITH RECURSIVE" if RECURSIVE & set(order) else "WITH"
    return f"{word} " + ",\n".join(f"{n} AS ({SHARED[n]})" for n in order) + "\n" + select
