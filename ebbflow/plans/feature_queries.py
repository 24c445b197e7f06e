"""Queries for the window-feature operators."""

from __future__ import annotations

from ..operators import features as fe
from ..sources import fixtures as fx
from . import query
from .oracle_views import r, with_views

KEYS = "customer_id, product_id"
WIN = f"WINDOW w AS (PARTITION BY {KEYS} ORDER BY ds)"


def _frame(lo: int, hi: int) -> str:
    def b(x):
        if x == 0:
            return "CURRENT ROW"
        return f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"
    return f"(PARTITION BY {KEYS} ORDER BY ds ROWS BETWEEN {b(lo)} AND {b(hi)})"


def _ds(sql):
    return with_views(sql, "daily_series")


def _dense(sql):
    return with_views(sql, "daily_series_dense")


@query("lags", _ds(f"""
SELECT *, lag(order_qty, 1) OVER w AS qty_lag_1, lag(order_qty, 7) OVER w AS qty_lag_7,
       lag(revenue, 1) OVER w AS revenue_lag_1, lag(revenue, 7) OVER w AS revenue_lag_7,
       lag(discount_percent, 1) OVER w AS discount_percent_lag_1, lag(price, 1) OVER w AS price_lag_1
FROM daily_series {WIN}"""))
def lags(spark, sf_dir):
    return fe.lags(fx.daily_series(spark, sf_dir))


def _rolling_sql(lo, hi, sfx):
    f = _frame(lo, hi)
    return _ds(f"""
SELECT *, {r(f'avg(order_qty) OVER {f}')} AS qty_rolling_mean{sfx},
       {r(f'stddev_samp(order_qty) OVER {f}')} AS qty_rolling_std{sfx},
       {r(f'avg(revenue) OVER {f}')} AS revenue_rolling_mean{sfx},
       {r(f'stddev_samp(revenue) OVER {f}')} AS revenue_rolling_std{sfx}
FROM daily_series""")


@query("rolling_7", _rolling_sql(-6, 0, "_7"))
def rolling_7(spark, sf_dir):
    return fe.rolling(fx.daily_series(spark, sf_dir), window=7)


@query("rolling_7_past", _rolling_sql(-7, -1, "_7_past"))
def rolling_7_past(spark, sf_dir):
    return fe.rolling(fx.daily_series(spark, sf_dir), window=7, past_only=True)


@query("series_lags", _ds(
    "SELECT *, " + ", ".join(
        f"{r(f'coalesce(lag(order_qty, {n}) OVER w, avg(order_qty) OVER (PARTITION BY {KEYS}))')} AS lag_{n}"
        for n in (1, 3, 7, 14)) + f" FROM daily_series {WIN}"))
def series_lags(spark, sf_dir):
    return fe.series_lags(fx.daily_series(spark, sf_dir))


@query("rolling_multi", _ds(
    f"WITH x AS (SELECT *, coalesce(order_qty - lag(order_qty) OVER w, 0.0) AS _diff FROM daily_series {WIN}) "
    "SELECT * EXCLUDE (_diff), " + ", ".join(
        f"{r(f'avg(order_qty) OVER {_frame(-(n - 1), 0)}')} AS rolling_mean_{n}, "
        f"{r(f'coalesce(stddev_samp(order_qty) OVER {_frame(-(n - 1), 0)}, 0.0)')} AS rolling_std_{n}, "
        f"{r(f'avg(_diff) OVER {_frame(-(n - 1), 0)}')} AS rolling_trend_{n}"
        for n in (3, 7, 14)) + " FROM x"))
def rolling_multi(spark, sf_dir):
    return fe.rolling_multi(fx.daily_series(spark, sf_dir))


# ---- E06, E08-E14: one column each, same definitions as the one-pass operator

_F14 = _frame(-14, -1)
_F7P = _frame(-7, -1)
_F28P = _frame(-28, -1)
_F28 = _frame(-27, 0)
_F82 = _frame(-8, -2)
_UNB = f"(PARTITION BY {KEYS} ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

# base CTE with every helper column the single features need
_BASE = f"""
b0 AS (SELECT *, row_number() OVER w AS _rn,
              coalesce(lag(order_qty) OVER w = 0, false) AS _z,
              CASE WHEN lag(order_qty) OVER w > 0 THEN ds END AS _marked,
              CASE WHEN count(order_qty) OVER {_F7P} >= 4 THEN avg(order_qty) OVER {_F7P} END AS _m7
       FROM {{src}} {WIN}),
b AS (SELECT *, last_value(CASE WHEN NOT _z THEN _rn END IGNORE NULLS) OVER {_UNB} AS _brk,
             last_value(_marked IGNORE NULLS) OVER {_UNB} AS _lastpos
      FROM b0)"""

_SINGLE = {
    "past_mean_14": (f"{r(f'coalesce(CASE WHEN count(order_qty) OVER {_F14} >= 3 THEN avg(order_qty) OVER {_F14} END, 0.0)')}",
                     "qty_roll14"),
    "days_since_positive": ("cast(least(greatest(coalesce(date_diff('day', _lastpos, ds), 999), 0), 999) AS INTEGER)",
                            "days_since_pos_order"),
    "zero_streak": ("cast(_rn - coalesce(_brk, 0) AS INTEGER)", "zero_streak"),
    "zero_share_28": (f"{r(f'coalesce(CASE WHEN count(*) OVER {_F28} >= 7 THEN avg(cast(_z AS DOUBLE)) OVER {_F28} END, 0.0)')}",
                      "zero_share_28"),
    "trend_14": (f"{r('coalesce(_m7 - lag(_m7, 7) OVER w, 0.0)')}", "qty_trend_14"),
    "cv_28": (f"{r(f'least(greatest(coalesce(CASE WHEN count(order_qty) OVER {_F28P} >= 7 THEN stddev_samp(order_qty) OVER {_F28P} / (avg(order_qty) OVER {_F28P} + 1e-6) END, 0.0), 0.0), 10.0)')}",
              "qty_cv_28"),
    "price_ratio_28": (f"{r(f'coalesce(lag(price) OVER w / (CASE WHEN count(price) OVER {_F28P} >= 7 THEN quantile_cont(price, 0.5) OVER {_F28P} END + 1e-6), 1.0)')}",
                       "price_ratio_28"),
    "prev_spike_7": (f"cast(coalesce(lag(order_qty) OVER w > 1.5 * (CASE WHEN count(order_qty) OVER {_F82} >= 4 THEN avg(order_qty) OVER {_F82} END + 1e-6), false) AS INTEGER)",
                     "prev_spike_7"),
}
# zero-based features need the zero-filled calendar to be meaningful
_DENSE_FEATURES = {"days_since_positive", "zero_streak", "zero_share_28"}


def _register_single(name: str) -> None:
    expr, col = _SINGLE[name]
    dense = name in _DENSE_FEATURES
    src = "daily_series_dense" if dense else "daily_series"
    sql = with_views(f"WITH {_BASE.format(src=src)} SELECT {KEYS}, ds, order_qty, {expr} AS {col} "
                     f"FROM b {WIN}", src)

    @query(name, sql)
    def _q(spark, sf_dir, col=col, dense=dense):
        src_df = (fx.daily_series_dense if dense else fx.daily_series)(spark, sf_dir)
        return fe.single_feature(src_df, col)


for _n in _SINGLE:
    _register_single(_n)


# E20 in SQL (also a building block of the E17 oracle)
TAIL_SQL = (
    f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ds DESC) AS rd, "
    f"lead(order_qty) OVER (PARTITION BY {KEYS} ORDER BY ds DESC) AS nxt FROM daily_series), "
    f"g AS (SELECT {KEYS}, count(*) AS n, avg(order_qty) AS mean, max(ds) AS last_date, "
    + ", ".join(f"max(CASE WHEN rd = {n} THEN order_qty END) AS l{n}" for n in (1, 3, 7, 14)) + ", "
    + ", ".join(f"avg(CASE WHEN rd <= {n} THEN order_qty END) AS m{n}, "
                f"stddev_samp(CASE WHEN rd <= {n} THEN order_qty END) AS s{n}, "
                f"sum(CASE WHEN rd < {n} THEN order_qty - nxt END) AS d{n}" for n in (3, 7, 14))
    + f" FROM x GROUP BY {KEYS}) "
    f"SELECT {KEYS}, last_date, {r('mean')} AS series_mean, "
    + ", ".join(f"{r(f'CASE WHEN n >= {n} THEN l{n} ELSE mean END')} AS lag_{n}" for n in (1, 3, 7, 14)) + ", "
    + ", ".join(f"{r(f'CASE WHEN n >= {n} THEN m{n} ELSE mean END')} AS rolling_mean_{n}, "
                f"{r(f'CASE WHEN n >= {n} THEN coalesce(s{n}, 0.0) ELSE 0.0 END')} AS rolling_std_{n}, "
                f"{r(f'CASE WHEN n >= {n} THEN coalesce(d{n}, 0.0) / {n} ELSE 0.0 END')} AS rolling_trend_{n}"
                for n in (3, 7, 14)) + " FROM g")


@query("tail_features", _ds(TAIL_SQL))
def tail_features(spark, sf_dir):
    return fe.tail_features(fx.daily_series(spark, sf_dir))


@query("history_tail", _ds(f"""
SELECT * EXCLUDE (rd) FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ds DESC) AS rd
                            FROM daily_series) WHERE rd <= 14"""))
def history_tail(spark, sf_dir):
    return fe.history_tail(fx.daily_series(spark, sf_dir), 14)


@query("recent_combos", _ds(f"""
SELECT DISTINCT {KEYS} FROM daily_series WHERE ds > (SELECT max(ds) FROM daily_series) - 28"""))
def recent_combos(spark, sf_dir):
    return fe.recent_combos(fx.daily_series(spark, sf_dir), 28)


def _signal_sql() -> str:
    """No series is cut: the largest block with signal is all rows up to the last one."""
    return _dense(f"""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ds) AS pos FROM daily_series_dense),
e AS (SELECT {KEYS}, max(CASE WHEN coalesce(order_qty, 0) > 0 THEN pos END) AS last_signal FROM x GROUP BY {KEYS})
SELECT x.* EXCLUDE (pos) FROM x JOIN e USING ({KEYS}) WHERE last_signal IS NULL OR pos <= last_signal""")


@query("recent_signal_window", _signal_sql())
def recent_signal_window(spark, sf_dir):
    return fe.recent_signal_window(fx.daily_series_dense(spark, sf_dir))


@query("training_slice", _dense(f"""
WITH x AS (SELECT *, count_if(coalesce(order_qty, 0) > 0) OVER (PARTITION BY {KEYS}) AS nz FROM daily_series_dense)
SELECT * EXCLUDE (nz) FROM x WHERE nz < 200 OR coalesce(order_qty, 0) > 0"""))
def training_slice(spark, sf_dir):
    return fe.training_slice(fx.daily_series_dense(spark, sf_dir))
