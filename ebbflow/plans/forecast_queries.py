"""Queries for forecasts (G01-G15), accuracy (I01-I10), the forecast-vs-actual
timeline and accuracy by group (F37, F40), splits and the feature matrix
(G21-G23, E15, E17), and the models (G16-G18, G24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6, round_to
from ..operators import accuracy as ac
from ..operators import boosting as bo
from ..operators import cube
from ..operators import features as fe
from ..operators import forecast as fcst
from ..operators import models as md
from ..operators.clean import beside
from ..session import cut_lineage
from ..sources import fixtures as fx
from . import fitted, query, written_series
from .feature_queries import TAIL_SQL
from .join_queries import _GRID
from .oracle_views import r, with_views

KEYS = "customer_id, product_id"
H = 30  # forecast horizon of the registered queries


def _tail_sql(src: str, keys: str, ds: str, q: str, flag: str | None = None) -> str:
    extra = ""
    if flag:
        extra = (f", avg(CASE WHEN NOT {flag} THEN {q} END) AS base_avg, "
                 f"avg(CASE WHEN {flag} THEN {q} END) AS promo_avg, count_if({flag}) AS promo_days")
    return f"""
tx AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ds} DESC) AS _rd FROM {src}),
st AS (SELECT {keys}, count(*) AS n, max({ds}) AS last_date, avg({q}) AS mean_all,
              avg(CASE WHEN _rd <= 30 THEN {q} END) AS m30,
              stddev_samp(CASE WHEN _rd <= 30 THEN {q} END) AS s30,
              avg(CASE WHEN _rd <= 7 THEN {q} END) AS m7,
              avg(CASE WHEN _rd <= 14 THEN {q} END) AS m14,
              avg(CASE WHEN _rd > 7 AND _rd <= 14 THEN {q} END) AS m8_14{extra}
       FROM tx GROUP BY {keys})"""


def _dm_sql(src: str, keys: str, ds: str, q: str) -> str:
    return f"dm AS (SELECT {keys}, isodow({ds}) - 1 AS _dow, avg({q}) AS dow_mean FROM {src} GROUP BY ALL)"


def _grid_sql(src_cte: str, ds: str, days: int = H) -> str:
    return (f"h0 AS (SELECT *, cast(unnest(range(0, {days})) AS INTEGER) AS step FROM {src_cte}), "
            f"h AS (SELECT *, last_date + step + 1 AS {ds}, isodow(last_date + step + 1) - 1 AS _dow FROM h0)")


def _on(keys: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


# ------------------------------------------------------------------ G01-G08

@query("simple_forecast", with_views(f"""
WITH {_tail_sql('daily_series', KEYS, 'ds', 'order_qty')},
{_dm_sql('daily_series', KEYS, 'ds', 'order_qty')},
st2 AS (SELECT *, CASE WHEN n > 7 THEN (m7 - m14) / 7 ELSE 0.0 END AS trend FROM st),
{_grid_sql('st2', 'ds')},
v AS (SELECT h.{KEYS.replace(', ', ', h.')}, h.ds, h.step,
             greatest(coalesce(dm.dow_mean, h.m30) + h.trend * h.step, 0.0) AS v
      FROM h LEFT JOIN dm ON {_on(KEYS, 'h', 'dm')} AND h._dow = dm._dow)
SELECT {KEYS}, ds, step, cast(round_even(v, 0) AS BIGINT) AS forecast,
       cast(round_even(v * 1.2, 0) AS BIGINT) AS upper, cast(round_even(v * 0.8, 0) AS BIGINT) AS lower
FROM v""", "daily_series"))
def simple_forecast(spark, sf_dir):
    return fcst.simple_forecast(fx.daily_series(spark, sf_dir), days=H)


_G02_CTE = f"""
{_tail_sql('daily_series', KEYS, 'ds', 'order_qty', 'is_promotional')},
{_dm_sql('daily_series', KEYS, 'ds', 'order_qty')},
st2 AS (SELECT {KEYS}, last_date, coalesce(base_avg, mean_all) AS hb,
               CASE WHEN coalesce(base_avg, mean_all) > 0 AND coalesce(promo_avg, 0.0) > 0
                    THEN least(greatest(coalesce(promo_avg, 0.0) / coalesce(base_avg, mean_all) - 1.0, 0.1), 3.0)
                    ELSE 0.3 END AS lift,
               promo_days / n AS freq,
               CASE WHEN n >= 14 AND m8_14 > 0 THEN (m7 - m8_14) / 7 ELSE 0.0 END AS trend FROM st),
{_grid_sql('st2', 'ds')},
b AS (SELECT h.*, greatest(greatest(coalesce(dm.dow_mean, h.hb), 10.0) + h.trend * h.step, 10.0) AS base
      FROM h LEFT JOIN dm ON {_on(KEYS, 'h', 'dm')} AND h._dow = dm._dow),
g02 AS (SELECT {KEYS}, ds, step, cast(round_even(base, 0) AS BIGINT) AS base_forecast,
               cast(round_even(base * lift * freq, 0) AS BIGINT) AS promotional_forecast FROM b)"""


@query("daily_base_promo", with_views(f"""
WITH {_G02_CTE}
SELECT *, base_forecast + promotional_forecast AS total_forecast FROM g02""", "daily_series"))
def daily_base_promo(spark, sf_dir):
    return fcst.daily_base_promo(fx.daily_series(spark, sf_dir), days=H)


@query("baseline_band", with_views(f"""
WITH {_G02_CTE}
SELECT *, base_forecast + promotional_forecast AS total_forecast,
       cast(floor((base_forecast + promotional_forecast) * 1.1) AS BIGINT) AS upper,
       cast(floor((base_forecast + promotional_forecast) * 0.9) AS BIGINT) AS lower FROM g02""", "daily_series"))
def baseline_band(spark, sf_dir):
    return fcst.baseline_band(fcst.daily_base_promo(fx.daily_series(spark, sf_dir), days=H))


_G03_CTE = f"""
{_tail_sql('daily_series', KEYS, 'ds', 'order_qty', 'is_promotional')},
{_dm_sql('daily_series', KEYS, 'ds', 'order_qty')},
st2 AS (SELECT {KEYS}, last_date, coalesce(base_avg, mean_all) AS hb,
               CASE WHEN promo_avg IS NULL THEN 0.5 ELSE least(greatest(
                 CASE WHEN coalesce(base_avg, mean_all) > 0 THEN promo_avg / coalesce(base_avg, mean_all) - 1
                      ELSE 0.5 END, 0.0), 3.0) END AS promo_lift FROM st),
{_grid_sql('st2', 'ds')},
pd AS (SELECT DISTINCT lower(trim(product_id)) AS pk,
              cast(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day
       FROM promo_calendar WHERE start_date IS NOT NULL AND end_date IS NOT NULL),
b AS (SELECT h.*, coalesce(dm.dow_mean, h.hb) AS base, pd.pk IS NOT NULL AS active
      FROM h LEFT JOIN dm ON {_on(KEYS, 'h', 'dm')} AND h._dow = dm._dow
      LEFT JOIN pd ON lower(trim(h.product_id)) = pd.pk AND h.ds = pd.day),
g03 AS (SELECT {KEYS}, ds, step, promo_lift,
               cast(round_even(greatest(base, 0.0), 0) AS BIGINT) AS base_demand_forecast,
               cast(round_even(greatest(CASE WHEN active THEN base * promo_lift ELSE 0.0 END, 0.0), 0) AS BIGINT)
                 AS promotional_demand_forecast FROM b)"""


@query("promo_forecast", with_views(f"WITH {_G03_CTE} SELECT * FROM g03", "daily_series", "promo_calendar"))
def promo_forecast(spark, sf_dir):
    return fcst.promo_forecast(fx.daily_series(spark, sf_dir), fx.promo_calendar(spark, sf_dir), days=H)


@query("promo_forecast_summary", with_views(f"""
WITH {_G03_CTE},
s AS (SELECT {KEYS}, sum(base_demand_forecast) AS total_base, sum(promotional_demand_forecast) AS total_promo,
             count_if(promotional_demand_forecast > 0) AS promo_days, max(promo_lift) AS lift
      FROM g03 GROUP BY ALL),
hh AS (SELECT {KEYS}, count_if(is_promotional) / count(*) AS f FROM daily_series GROUP BY ALL)
SELECT s.{KEYS.replace(', ', ', s.')}, total_base, total_promo,
       {r('CASE WHEN total_base > 0 THEN total_promo / total_base ELSE 0.0 END')} AS promo_base_ratio,
       promo_days, {r('lift')} AS avg_promotional_lift, {r('f')} AS hist_promo_frequency,
       total_base + total_promo AS total_embedded
FROM s LEFT JOIN hh ON {_on(KEYS, 's', 'hh')}""", "daily_series", "promo_calendar"))
def promo_forecast_summary(spark, sf_dir):
    d = fx.daily_series(spark, sf_dir)
    return fcst.promo_forecast_summary(fcst.promo_forecast(d, fx.promo_calendar(spark, sf_dir), days=H), d)


_BRAND_DAY = ("bd AS (SELECT brand, order_date, sum(total_demand_qty) AS total_demand_qty "
              "FROM demand_history GROUP BY ALL)")


@query("rollup_forecast", with_views(f"""
WITH {_BRAND_DAY},
{_tail_sql('bd', 'brand', 'order_date', 'total_demand_qty')},
s1 AS (SELECT *, CASE WHEN m30 > 0 THEN m30 ELSE greatest(mean_all, 100.0) END AS ra FROM st),
s2 AS (SELECT *, CASE WHEN s30 > 0 THEN s30 ELSE ra * 0.2 END AS rs,
              CASE WHEN n >= 14 AND m8_14 > 0 THEN least(greatest((m7 - m8_14) / 7, -ra * 0.1), ra * 0.1)
                   ELSE 0.0 END AS slope FROM s1),
{_grid_sql('s2', 'order_date')},
b AS (SELECT *, greatest((ra + slope * (step + 1)) * [0.9, 0.95, 1.0, 1.05, 1.1, 1.2, 1.15][_dow + 1], 1.0) AS base
      FROM h)
SELECT brand, order_date, step, cast(round_even(base, 0) AS BIGINT) AS forecast,
       cast(round_even(base + 1.96 * rs, 0) AS BIGINT) AS upper,
       cast(round_even(greatest(base - 1.96 * rs, 0.0), 0) AS BIGINT) AS lower, {r('slope')} AS trend_slope
FROM b""", "demand_history"))
def rollup_forecast(spark, sf_dir):
    agg = cube.rollup(fx.demand_history(spark, sf_dir), "brand_day")
    return fcst.rollup_forecast(agg, ["brand"], days=H)


@query("current_forecast", with_views(f"""
WITH x AS (SELECT *, max(ds) OVER (PARTITION BY {KEYS}) + 1 AS _t,
                  row_number() OVER (PARTITION BY {KEYS} ORDER BY ds DESC) AS _rd,
                  row_number() OVER (PARTITION BY {KEYS}, isodow(ds) ORDER BY ds DESC) AS _rdd
           FROM daily_series),
g AS (SELECT {KEYS}, max(_t) AS target_date, count(*) AS n, avg(order_qty) AS mean_all,
             count_if(isodow(ds) = isodow(_t)) AS n_dow,
             avg(CASE WHEN isodow(ds) = isodow(_t) AND _rdd <= 6 THEN order_qty END) AS recent_dow,
             avg(CASE WHEN isodow(ds) = isodow(_t) AND _rdd > 6 THEN order_qty END) AS older_dow,
             count_if(month(ds) = month(_t)) AS n_month,
             avg(CASE WHEN month(ds) = month(_t) THEN order_qty END) AS month_avg,
             avg(CASE WHEN _rd <= 30 THEN order_qty END) AS m30, avg(CASE WHEN _rd <= 7 THEN order_qty END) AS m7,
             avg(CASE WHEN _rd > 7 AND _rd <= 14 THEN order_qty END) AS m8_14
      FROM x GROUP BY ALL),
c AS (SELECT *, CASE WHEN n_dow > 6 THEN older_dow ELSE recent_dow END AS older FROM g),
d AS (SELECT *,
        CASE WHEN n_dow >= 3 THEN CASE WHEN older > 0 THEN recent_dow * least(greatest(recent_dow / older, 0.5), 2.0)
                                       ELSE recent_dow END END AS c1,
        CASE WHEN n_month >= 5 AND m30 > 0 THEN m30 * month_avg / mean_all END AS c2,
        CASE WHEN n >= 14 AND m8_14 > 0 THEN m7 * least(greatest(m7 / m8_14, 0.7), 1.5) END AS c3 FROM c)
SELECT {KEYS}, target_date, {r('coalesce(c1, c2, c3, m30)')} AS forecast,
       CASE WHEN c1 IS NOT NULL THEN 'day_of_week' WHEN c2 IS NOT NULL THEN 'monthly'
            WHEN c3 IS NOT NULL THEN 'trend' ELSE 'recent_average' END AS method
FROM d""", "daily_series"))
def current_forecast(spark, sf_dir):
    return fcst.current_forecast(fx.daily_series(spark, sf_dir))


@query("statistical_baseline", with_views(f"""
WITH st AS (SELECT {KEYS}, max(ds) AS last_date FROM daily_series GROUP BY ALL),
{_dm_sql('daily_series', KEYS, 'ds', 'order_qty')},
{_grid_sql('st', 'ds')},
v AS (SELECT h.{KEYS.replace(', ', ', h.')}, h.ds, h.step,
             cast(greatest(round_even(coalesce(dm.dow_mean, 100.0), 0), 0.0) AS BIGINT) AS forecast
      FROM h LEFT JOIN dm ON {_on(KEYS, 'h', 'dm')} AND h._dow = dm._dow)
SELECT *, cast(floor(forecast * 1.2) AS BIGINT) AS upper, cast(floor(forecast * 0.8) AS BIGINT) AS lower FROM v""",
    "daily_series"))
def statistical_baseline(spark, sf_dir):
    return fcst.statistical_baseline(fx.daily_series(spark, sf_dir), days=H)


# ------------------------------------------------------------------ G09-G13

_VB = f"""
vb AS (SELECT *, max(ds) OVER (PARTITION BY {KEYS}) + 1 AS _t,
              row_number() OVER (PARTITION BY {KEYS} ORDER BY ds DESC) AS _rd,
              row_number() OVER (PARTITION BY {KEYS} ORDER BY ds) AS _rn,
              row_number() OVER (PARTITION BY {KEYS}, isodow(ds) ORDER BY ds DESC) AS _rdd,
              row_number() OVER (PARTITION BY {KEYS}, isodow(ds) ORDER BY ds) AS _rnd
       FROM daily_series)"""


@query("v_day_of_week_trend", with_views(f"""
WITH {_VB},
g AS (SELECT {KEYS}, max(_t) AS target_date, avg(order_qty) AS m,
             count_if(isodow(ds) = isodow(_t)) AS nd, avg(CASE WHEN isodow(ds) = isodow(_t) THEN order_qty END) AS md,
             avg(CASE WHEN isodow(ds) = isodow(_t) AND _rdd <= 3 THEN order_qty END) AS r3,
             avg(CASE WHEN isodow(ds) = isodow(_t) AND _rnd <= 3 THEN order_qty END) AS o3
      FROM vb GROUP BY ALL)
SELECT {KEYS}, target_date,
       {r('CASE WHEN nd >= 6 THEN r3 * least(greatest(CASE WHEN o3 > 0 THEN r3 / o3 ELSE 1.0 END, 0.7), 1.5) WHEN nd >= 3 THEN md ELSE m END')} AS forecast
FROM g""", "daily_series"))
def v_day_of_week_trend(spark, sf_dir):
    return fcst.version_dow_trend(fx.daily_series(spark, sf_dir))


@query("v_exponential_smoothing", with_views(f"""
WITH {_VB}
SELECT {KEYS}, max(_t) AS target_date,
       {r('sum(CASE WHEN _rn = 1 THEN pow(0.7, _rn + _rd - 2) ELSE 0.3 * pow(0.7, _rd - 1) END * order_qty)')} AS forecast
FROM vb GROUP BY ALL""", "daily_series"))
def v_exponential_smoothing(spark, sf_dir):
    return fcst.version_ses(fx.daily_series(spark, sf_dir))


@query("v_seasonal_moving_average", with_views(f"""
WITH {_VB},
g AS (SELECT {KEYS}, max(_t) AS target_date, avg(order_qty) AS m,
             avg(CASE WHEN _rd <= 7 THEN order_qty END) AS r7,
             avg(CASE WHEN month(ds) = month(_t) THEN order_qty END) AS mm FROM vb GROUP BY ALL)
SELECT {KEYS}, target_date,
       {r('CASE WHEN mm IS NOT NULL AND m <> 0 THEN r7 * least(greatest(mm / m, 0.5), 2.0) ELSE r7 END')} AS forecast
FROM g""", "daily_series"))
def v_seasonal_moving_average(spark, sf_dir):
    return fcst.version_seasonal(fx.daily_series(spark, sf_dir))


@query("v_linear_trend", with_views(f"""
WITH {_VB},
x AS (SELECT *, least(_rn + _rd - 1, 14) AS _m, cast(least(_rn + _rd - 1, 14) - _rd AS DOUBLE) AS _x FROM vb),
g AS (SELECT {KEYS}, max(_t) AS target_date, avg(order_qty) AS m, count(*) AS n, max(_m) AS mm,
             regr_slope(CASE WHEN _rd <= 14 THEN order_qty END, CASE WHEN _rd <= 14 THEN _x END) AS b,
             regr_intercept(CASE WHEN _rd <= 14 THEN order_qty END, CASE WHEN _rd <= 14 THEN _x END) AS a
      FROM x GROUP BY ALL)
SELECT {KEYS}, target_date, {r('CASE WHEN n >= 10 THEN greatest(a + b * mm, 0.0) ELSE m END')} AS forecast
FROM g""", "daily_series"))
def v_linear_trend(spark, sf_dir):
    return fcst.version_linear(fx.daily_series(spark, sf_dir))


@query("v_weighted_recent", with_views(f"""
WITH {_VB},
x AS (SELECT *, CASE WHEN _rd <= 10 THEN least(_rn + _rd - 1, 10) - _rd + 1 END AS w FROM vb)
SELECT {KEYS}, max(_t) AS target_date, {r('sum(w * order_qty) / sum(w)')} AS forecast
FROM x GROUP BY ALL""", "daily_series"))
def v_weighted_recent(spark, sf_dir):
    return fcst.version_weighted(fx.daily_series(spark, sf_dir))


# ------------------------------------------------------------------ G14, G15, I

@query("ma_backtest", with_views(
    f"SELECT forecast_version_name, order_date, actual, {r('forecast')} AS forecast FROM backtest", "backtest"))
def ma_backtest(spark, sf_dir):
    return fx.backtest(spark, sf_dir).withColumn("forecast", r6("forecast"))


def _errors_sql(src: str) -> str:
    return f"""
SELECT *, abs(forecast - actual) AS absolute_error,
       CASE WHEN actual <> 0 THEN abs(forecast - actual) / abs(actual) * 100 WHEN forecast = 0 THEN 0.0 END
         AS absolute_percentage_error,
       forecast - actual AS bias, (forecast - actual) * (forecast - actual) AS squared_error
FROM {src}"""


def _summary_sql(src: str, keys: str) -> str:
    return f"""
SELECT {keys}, {r('avg(absolute_error)')} AS mae, {r('avg(absolute_percentage_error)')} AS mape,
       {r('avg(bias)')} AS bias,
       {r('CASE WHEN sum(actual) > 0 THEN sum(bias) / sum(actual) * 100 ELSE 0.0 END')} AS bias_percentage,
       {r('sqrt(avg(squared_error))')} AS rmse, count(*) AS data_points
FROM ({_errors_sql(src)}) GROUP BY {keys}"""


@query("point_errors", with_views("SELECT forecast_version_name, order_date, actual, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("forecast", "absolute_error", "absolute_percentage_error", "bias", "squared_error"))
    + f" FROM ({_errors_sql('backtest')})", "backtest"))
def point_errors(spark, sf_dir):
    x = ac.point_errors(fx.backtest(spark, sf_dir))
    return x.withColumns({c: r6(c) for c in ("forecast", "absolute_error", "absolute_percentage_error",
                                             "bias", "squared_error")})


@query("error_summary", with_views(_summary_sql("backtest", "forecast_version_name"), "backtest"))
def error_summary(spark, sf_dir):
    return ac.error_summary(fx.backtest(spark, sf_dir), ["forecast_version_name"])


_GRADE = ("CASE WHEN mape IS NULL OR isnan(mape) THEN 'N/A' WHEN mape <= 10 THEN 'Excellent' "
          "WHEN mape <= 20 THEN 'Good' WHEN mape <= 30 THEN 'Fair' WHEN mape <= 50 THEN 'Poor' "
          "ELSE 'Very Poor' END")


@query("accuracy_grade", with_views(
    f"SELECT *, {_GRADE} AS accuracy_grade FROM ({_summary_sql('backtest', 'forecast_version_name')})",
    "backtest"))
def accuracy_grade(spark, sf_dir):
    return ac.accuracy_grade(ac.error_summary(fx.backtest(spark, sf_dir), ["forecast_version_name"]))


_CLASS = ("CASE WHEN abs(bias_percentage) > 5 THEN CASE WHEN bias_percentage > 0 THEN 'over_forecasting' "
          "ELSE 'under_forecasting' END ELSE 'neutral' END AS bias_direction, "
          "CASE WHEN abs(bias_percentage) > 15 THEN 'high' WHEN abs(bias_percentage) > 8 THEN 'medium' "
          "ELSE 'low' END AS bias_severity")


@query("bias_class", with_views(
    f"SELECT *, {_CLASS} FROM ({_summary_sql('backtest', 'forecast_version_name')})", "backtest"))
def bias_class(spark, sf_dir):
    return ac.bias_class(ac.error_summary(fx.backtest(spark, sf_dir), ["forecast_version_name"]))


@query("bias_messages", with_views(f"""
WITH c AS (SELECT *, {_CLASS} FROM ({_summary_sql('backtest', 'forecast_version_name')})),
o AS (SELECT coalesce(string_agg(CASE WHEN bias_severity = 'high' THEN forecast_version_name END, ', '
                                 ORDER BY forecast_version_name), '') AS hi,
             count_if(bias_direction = 'over_forecasting') AS ov, count_if(bias_direction = 'under_forecasting') AS un,
             arg_min(forecast_version_name, (abs(bias_percentage), forecast_version_name)) AS bv,
             arg_min(bias_percentage, (abs(bias_percentage), forecast_version_name)) AS bp FROM c),
m AS (SELECT concat_ws(' | ',
        CASE WHEN hi <> '' THEN 'High bias detected in models: ' || hi || '. Consider model recalibration.' END,
        CASE WHEN ov > un THEN 'Systematic over-forecasting detected across multiple models. Consider reducing baseline forecasts.'
             WHEN un > ov THEN 'Systematic under-forecasting detected across multiple models. Consider increasing baseline forecasts.' END,
        CASE WHEN abs(bp) < 5 THEN 'Model ''' || bv || ''' shows minimal bias (' || cast({r('bp', 1)} AS VARCHAR) || '%) - consider as primary model.' END
      ) AS l FROM o)
SELECT forecast_version_name,
       CASE WHEN abs(bias_percentage) <= 5 THEN forecast_version_name || ': Bias within acceptable range'
            WHEN bias_percentage > 15 THEN forecast_version_name || ': High over-forecasting'
            WHEN bias_percentage < -15 THEN forecast_version_name || ': High under-forecasting'
            ELSE forecast_version_name || ': No recommendations' END AS message FROM c
UNION ALL
SELECT 'overall', CASE WHEN l = '' THEN 'Bias levels are within acceptable ranges across all models.'
                       ELSE l END FROM m""", "backtest"))
def bias_messages(spark, sf_dir):
    return ac.bias_messages(ac.error_summary(fx.backtest(spark, sf_dir), ["forecast_version_name"]))


@query("bias_recommendations", with_views(f"""
SELECT *, concat_ws(' | ',
         CASE WHEN abs(bias_percentage) <= 5 THEN 'Bias is within acceptable range (±5%)'
              WHEN bias_percentage > 15 THEN 'Significant over-forecasting detected. Consider reducing forecast levels.'
              WHEN bias_percentage < -15 THEN 'Significant under-forecasting detected. Consider increasing forecast levels.'
              WHEN bias_percentage > 5 THEN 'Moderate over-forecasting. Monitor and adjust if trend continues.'
              ELSE 'Moderate under-forecasting. Monitor and adjust if trend continues.' END,
         CASE WHEN mape > 30 THEN 'High forecast error detected. Consider model recalibration or alternative methods.' END) AS recommendations
FROM ({_summary_sql('backtest', 'forecast_version_name')})""", "backtest"))
def bias_recommendations(spark, sf_dir):
    return ac.bias_recommendations(ac.error_summary(fx.backtest(spark, sf_dir), ["forecast_version_name"]))


@query("overall_bias", with_views(f"""
WITH c AS (SELECT *, {_CLASS} FROM ({_summary_sql('backtest', 'forecast_version_name')}))
SELECT CASE WHEN count(*) = 0 THEN 'neutral'
            WHEN count_if(bias_direction = 'over_forecasting') > count_if(bias_direction = 'under_forecasting')
              THEN 'predominantly_over_forecasting'
            WHEN count_if(bias_direction = 'under_forecasting') > count_if(bias_direction = 'over_forecasting')
              THEN 'predominantly_under_forecasting'
            ELSE 'mixed_bias_patterns' END AS overall_bias_direction,
       count(*) AS version_count, count_if(bias_severity <> 'low') AS consistent_bias_versions,
       sum(data_points) AS total_data_points FROM c""", "backtest"))
def overall_bias(spark, sf_dir):
    return ac.overall_bias(ac.error_summary(fx.backtest(spark, sf_dir), ["forecast_version_name"]))


@query("bias_consistency", with_views(f"""
WITH e AS ({_errors_sql('backtest')}),
x AS (SELECT *, cast(row_number() OVER (PARTITION BY forecast_version_name ORDER BY order_date) - 1 AS DOUBLE) AS _i,
             CASE WHEN count(bias) OVER w7 >= 3 THEN avg(bias) OVER w7 END AS _roll FROM e
      WINDOW w7 AS (PARTITION BY forecast_version_name ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
g AS (SELECT forecast_version_name, count(*) AS n, corr(bias, _i) AS c, stddev_samp(bias) AS sd,
             count_if(abs(_roll) > 10) AS consistent_bias_periods FROM x GROUP BY ALL)
SELECT forecast_version_name, {r('c')} AS bias_trend_correlation,
       CASE WHEN c > 0.1 THEN 'increasing' WHEN c < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
       {r('sd')} AS bias_volatility, consistent_bias_periods FROM g WHERE n >= 8""", "backtest"))
def bias_consistency(spark, sf_dir):
    return ac.bias_consistency(fx.backtest(spark, sf_dir), ["forecast_version_name"], "order_date")


@query("bias_by_sku", with_views(f"""
SELECT sku_id, {r('avg(forecast - actual)', 2)} AS avg_bias, {r('stddev_samp(forecast - actual)', 2)} AS bias_volatility,
       count(forecast - actual) AS data_points FROM sku_backtest GROUP BY sku_id""", "sku_backtest"))
def bias_by_sku(spark, sf_dir):
    return ac.bias_by(fx.backtest(spark, sf_dir, "sku_id"), "sku_id")


@query("accuracy_by_group", with_views(
    f"SELECT * FROM ({_summary_sql('sku_backtest', 'sku_id')}) WHERE data_points >= 20", "sku_backtest"))
def accuracy_by_group(spark, sf_dir):
    s = ac.error_summary(fx.backtest(spark, sf_dir, "sku_id"), ["sku_id"])
    return s.where(F.col("data_points") >= 20)


@query("best_version", with_views(f"""
WITH s AS ({_summary_sql('backtest', 'forecast_version_name')}),
b AS (SELECT * FROM s WHERE mape IS NOT NULL ORDER BY mape, forecast_version_name LIMIT 1)
SELECT forecast_version_name AS best_version, mape, {_GRADE} AS grade, data_points,
       {r('data_points * 100.0 / (SELECT count(DISTINCT order_date) FROM demand_history)')} AS coverage_pct FROM b""",
    "backtest"))
def best_version(spark, sf_dir):
    return fcst.best_version(fx.backtest(spark, sf_dir), hist=fx.demand_history(spark, sf_dir))


# ------------------------------------------------------------------ F37

@query("forecast_vs_actual", with_views(f"""
WITH nd AS (SELECT order_date, sum(total_demand_qty) AS total_demand_qty FROM demand_history GROUP BY 1),
{_tail_sql('(SELECT 1 AS k, * FROM nd)', 'k', 'order_date', 'total_demand_qty')},
s1 AS (SELECT *, CASE WHEN m30 > 0 THEN m30 ELSE greatest(mean_all, 100.0) END AS ra FROM st),
s2 AS (SELECT *, CASE WHEN n >= 14 AND m8_14 > 0 THEN least(greatest((m7 - m8_14) / 7, -ra * 0.1), ra * 0.1)
                      ELSE 0.0 END AS slope FROM s1),
{_grid_sql('s2', 'order_date')},
f AS (SELECT order_date, cast(round_even(greatest((ra + slope * (step + 1)) *
              [0.9, 0.95, 1.0, 1.05, 1.1, 1.2, 1.15][_dow + 1], 1.0), 0) AS BIGINT) AS forecast FROM h)
SELECT coalesce(nd.order_date, f.order_date) AS order_date, nd.total_demand_qty AS actual,
       cast(f.forecast AS DOUBLE) AS forecast
FROM nd FULL OUTER JOIN f ON nd.order_date = f.order_date""", "demand_history"))
def forecast_vs_actual(spark, sf_dir):
    hist = cube.rollup(fx.demand_history(spark, sf_dir), "national_day")
    fc = fcst.rollup_forecast(hist.withColumn("_k", F.lit(1)), ["_k"], days=H)
    return fcst.forecast_vs_actual(hist, fc)


# ------------------------------------------------------------------ splits, metrics

_G21 = """
dts AS (SELECT DISTINCT ds FROM daily_series),
nd AS (SELECT count(*) AS n FROM dts),
rk AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS i FROM dts),
sd AS (SELECT ds AS split_date FROM rk WHERE i = (SELECT greatest(1, least(cast(floor(n * 0.8) AS INTEGER), n - 1)) FROM nd)),
ct AS (SELECT CASE WHEN (SELECT count(*) FROM daily_series WHERE ds < (SELECT split_date FROM sd) - 7) = 0
                     OR (SELECT count(*) FROM daily_series WHERE ds >= (SELECT split_date FROM sd)) = 0
                   THEN (SELECT split_date FROM sd) ELSE (SELECT split_date FROM sd) - 7 END AS cut),
g21 AS (SELECT d.*, CASE WHEN d.ds < ct.cut THEN 'train' WHEN d.ds >= sd.split_date THEN 'test' END AS split
        FROM daily_series d, ct, sd)"""


@query("split_chronological", with_views(f"WITH {_G21} SELECT * FROM g21 WHERE split IS NOT NULL", "daily_series"))
def split_chronological(spark, sf_dir):
    return md.split_chronological(fx.daily_series(spark, sf_dir))


@query("split_fraction", with_views(f"""
SELECT * EXCLUDE (_p), CASE WHEN _p <= floor((SELECT count(*) FROM daily_series) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY {KEYS}, ds) AS _p FROM daily_series)""", "daily_series"))
def split_fraction(spark, sf_dir):
    return md.split_fraction(fx.daily_series(spark, sf_dir))


@query("split_quantile", with_views("""
SELECT *, CASE WHEN date_diff('day', DATE '1970-01-01', ds) <=
              (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', ds), 0.8) FROM daily_series)
         THEN 'train' ELSE 'test' END AS split FROM daily_series""", "daily_series"))
def split_quantile(spark, sf_dir):
    return md.split_quantile(fx.daily_series(spark, sf_dir))


_F14 = f"(PARTITION BY {KEYS} ORDER BY ds ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"
_PRED = f"""
pr AS (SELECT *, coalesce(CASE WHEN count(order_qty) OVER {_F14} >= 3 THEN avg(order_qty) OVER {_F14} END, 0.0)
                 AS qty_roll14 FROM g21 WHERE split IS NOT NULL)"""


def _pred_frame(spark, sf_dir):
    d = md.split_chronological(fx.daily_series(spark, sf_dir))
    return d.withColumn("qty_roll14", fe.past_mean_col())


@query("regression_metrics", with_views(f"""
WITH {_G21}, {_PRED}
SELECT split, count(*) AS n, {r('avg(abs(qty_roll14 - order_qty))')} AS mae,
       {r('sqrt(avg((qty_roll14 - order_qty) * (qty_roll14 - order_qty)))')} AS rmse,
       {r('CASE WHEN var_pop(order_qty) > 0 THEN 1 - avg((qty_roll14 - order_qty) * (qty_roll14 - order_qty)) / var_pop(order_qty) WHEN avg((qty_roll14 - order_qty) * (qty_roll14 - order_qty)) = 0 THEN 1.0 ELSE 0.0 END')} AS r2,
       {r('avg(2.0 * abs(qty_roll14 - order_qty) / CASE WHEN abs(order_qty) + abs(qty_roll14) = 0 THEN 1.0 ELSE abs(order_qty) + abs(qty_roll14) END)')} AS smape,
       {r('avg(abs(qty_roll14 - order_qty) / greatest(abs(order_qty), 2.220446049250313e-16)) * 100')} AS mape,
       {r('CASE WHEN var_pop(order_qty) > 0 THEN var_pop(qty_roll14) / var_pop(order_qty) ELSE 0.0 END')} AS explained_variance,
       {r('avg(order_qty)')} AS mean_actual, {r('avg(qty_roll14)')} AS mean_predicted
FROM pr GROUP BY split""", "daily_series"))
def regression_metrics(spark, sf_dir):
    return ac.regression_metrics(_pred_frame(spark, sf_dir), "order_qty", "qty_roll14", "split")


@query("smape_leaderboard", with_views(f"""
WITH {_G21}, {_PRED},
s AS (SELECT customer_id, {r('avg(2.0 * abs(qty_roll14 - order_qty) / CASE WHEN abs(order_qty) + abs(qty_roll14) = 0 THEN 1.0 ELSE abs(order_qty) + abs(qty_roll14) END)')} AS smape,
             count(*) AS n_rows FROM pr WHERE split = 'test' GROUP BY customer_id HAVING count(*) >= 10)
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY smape, customer_id) AS rank, 'best' AS list FROM s) WHERE rank <= 20
UNION ALL
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY smape DESC, customer_id DESC) AS rank, 'worst' AS list FROM s)
WHERE rank <= 20""", "daily_series"))
def smape_leaderboard(spark, sf_dir):
    p = _pred_frame(spark, sf_dir).where(F.col("split") == "test")
    return ac.smape_leaderboard(p, "customer_id", "order_qty", "qty_roll14")


_E15_FEATURES = ["qty_lag_1", "qty_lag_7", "qty_rolling_mean_7_past", "qty_roll14", "order_month"]


@query("feature_matrix", with_views(f"""
WITH f AS (SELECT {KEYS}, ds, cast(lag(order_qty, 1) OVER w AS DOUBLE) AS qty_lag_1,
                  cast(lag(order_qty, 7) OVER w AS DOUBLE) AS qty_lag_7,
                  {r(f'avg(order_qty) OVER (PARTITION BY {KEYS} ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS qty_rolling_mean_7_past,
                  {r(f'coalesce(CASE WHEN count(order_qty) OVER {_F14} >= 3 THEN avg(order_qty) OVER {_F14} END, 0.0)')} AS qty_roll14,
                  cast(month(ds) AS DOUBLE) AS order_month,
                  greatest(coalesce(cast(order_qty AS DOUBLE), 0.0), 0.0) AS label
           FROM daily_series WINDOW w AS (PARTITION BY {KEYS} ORDER BY ds))
SELECT {KEYS}, ds, """ + ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM f), 0.0) AS {c}" for c in _E15_FEATURES)
    + ", label FROM f", "daily_series"))
def feature_matrix(spark, sf_dir):
    x = md.training_frame(fx.daily_series(spark, sf_dir))
    return md.feature_matrix(x, _E15_FEATURES, keep=["customer_id", "product_id", "ds"])


@query("future_features", with_views(f"""
WITH {_GRID}, t AS ({TAIL_SQL})
SELECT g.*, t.* EXCLUDE (customer_id, product_id),
       year(g.ds) AS order_year, month(g.ds) AS order_month, day(g.ds) AS order_day,
       isodow(g.ds) - 1 AS order_day_of_week, quarter(g.ds) AS quarter,
       cast(day(g.ds) = 1 AS INTEGER) AS is_month_start, cast(g.ds = last_day(g.ds) AS INTEGER) AS is_month_end,
       cast(isodow(g.ds) - 1 >= 5 AS INTEGER) AS is_weekend
FROM g LEFT JOIN t USING (customer_id, product_id)""", "daily_series"))
def future_features(spark, sf_dir):
    d = fx.daily_series(spark, sf_dir)
    last = d.agg(F.max("ds")).scalar()
    return md.future_features(d, F.date_add(last, 1), F.date_add(last, 14))


# ------------------------------------------------------------------ MLlib models: what an oracle can tell of a fit

def _count_matrix(spark, sf_dir):
    """The written feature matrix with its split; the frame is written before, as medians read it again."""
    d = written_series(spark, sf_dir)
    x = cut_lineage(md.split_chronological(md.training_frame(d, fx.promo_calendar(spark, sf_dir))))
    train = x.where(F.col("split") == "train")
    mat = md.feature_matrix(x, md.COUNT_FEATURES, fit=train, keep=["customer_id", "product_id", "ds", "split"])
    return cut_lineage(mat)


def _count_fits(spark, sf_dir):
    """(matrix, Poisson GLM, boosted counts)."""
    mat = fitted(spark, sf_dir, "count matrix", lambda: _count_matrix(spark, sf_dir))
    train = mat.where(F.col("split") == "train")
    return (mat, fitted(spark, sf_dir, "count glm", lambda: md.train_counts(train, md.COUNT_FEATURES)),
            fitted(spark, sf_dir, "boosted counts", lambda: bo.train_boosted_counts(train, md.COUNT_FEATURES)))


def _count_predictions(spark, sf_dir):
    mat, glm, boosted = _count_fits(spark, sf_dir)
    return boosted.transform(md.predict(glm, mat), "boosted")


_NAIVE = """
SELECT split, count(*) AS n, {total} AS label_sum,
       {error} AS naive_mae, true AS learned
FROM rows_ GROUP BY split"""


def _evaluation_sql(label: str, source: str) -> str:
    """Split sizes, label totals and the naive error, which the model must beat
    on the rows it learned from (on others it must have an error at all)."""
    return (f"rows_ AS (SELECT split, greatest(coalesce(cast({label} AS DOUBLE), 0.0), 0.0) AS label FROM {source} WHERE split IS NOT NULL)"
            + _NAIVE.format(total="cast(sum(cast(label AS DECIMAL(38,6))) AS DOUBLE)", error=r("avg(abs(label - (SELECT avg(label) FROM rows_ WHERE split = 'train')))", 4)))


def _learned(evaluation):
    better = F.when(F.col("split") == "train", F.col("mae") < F.col("naive_mae")).otherwise(F.col("mae") < float("inf"))
    return evaluation.select("split", "n", "label_sum", round_to("naive_mae", 4).alias("naive_mae"), better.alias("learned"))


@query("count_model", with_views(f"WITH {_G21}, " + _evaluation_sql("order_qty", "g21").replace(
    "true AS learned", "true AS learned, true AS boosted_learned"), "daily_series"))
def count_model(spark, sf_dir):
    """Both learners on both splits, against always saying the training mean."""
    p = _count_predictions(spark, sf_dir)
    one = _learned(md.evaluate_predictions(p, "prediction"))
    two = _learned(md.evaluate_predictions(p, "boosted")).select("split", F.col("learned").alias("boosted_learned"))
    return one.join(two, "split")


@query("count_model_rows")
def count_model_rows(spark, sf_dir):
    """The count of every row on both splits, predicted by both learners."""
    return _count_predictions(spark, sf_dir).select("split", "customer_id", "product_id", "ds", "label", "prediction", "boosted")


@query("count_model_metrics")
def count_model_metrics(spark, sf_dir):
    """I09 of both fitted learners on both splits."""
    p = _count_predictions(spark, sf_dir)
    both = [ac.regression_metrics(p, "label", c).withColumn("learner", F.lit(n)) for n, c in (("glm", "prediction"), ("boosted", "boosted"))]
    return both[0].unionByName(both[1])


@query("count_model_leaderboard")
def count_model_leaderboard(spark, sf_dir):
    """I10 of the boosted counts on the test rows, by customer."""
    p = _count_predictions(spark, sf_dir).where(F.col("split") == "test")
    return ac.smape_leaderboard(p, "customer_id", "label", "boosted")


_REV_FEATURES = ["order_year", "order_month", "order_day", "order_day_of_week", "quarter", "is_month_start",
                 "is_month_end", "is_weekend", "revenue_lag_1", "revenue_lag_7", "revenue_rolling_mean_7_past",
                 "revenue_rolling_std_7_past", "qty_lag_1", "qty_rolling_mean_7_past"]


def _revenue_model(spark, sf_dir):
    def build():
        x = cut_lineage(md.split_fraction(md.training_frame(written_series(spark, sf_dir))))
        mat = cut_lineage(md.feature_matrix(x, _REV_FEATURES, target="revenue", fit=x.where(F.col("split") == "train"),
                                            keep=["customer_id", "product_id", "ds", "split"]))
        return md.train_gbt(mat.where(F.col("split") == "train"), _REV_FEATURES), mat
    return fitted(spark, sf_dir, "revenue model", build)


_G22 = f"""
g22 AS (SELECT * EXCLUDE (_p), CASE WHEN _p <= floor((SELECT count(*) FROM daily_series) * 0.8) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY {KEYS}, ds) AS _p FROM daily_series))"""


@query("revenue_model", with_views(f"WITH {_G22}, " + _evaluation_sql("revenue", "g22"), "daily_series"))
def revenue_model(spark, sf_dir):
    """The fitted revenue on both splits, against always saying the training mean."""
    model, mat = _revenue_model(spark, sf_dir)
    return _learned(md.evaluate(model, mat))


@query("revenue_model_rows")
def revenue_model_rows(spark, sf_dir):
    """The predicted revenue of every row on both splits."""
    model, mat = _revenue_model(spark, sf_dir)
    return md.predict(model, mat).select("split", "customer_id", "product_id", "ds", "label", "prediction")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    model, _ = _revenue_model(spark, sf_dir)
    return md.feature_importance(model, _REV_FEATURES)


_SCORE_FEATURES = ["order_month", "order_day_of_week", "is_weekend", "lag_1", "lag_7",
                   "rolling_mean_7", "rolling_mean_14", "rolling_std_7", "rolling_trend_7"]


def _score_range(spark, sf_dir):
    d = written_series(spark, sf_dir)

    def build():
        x = md.split_chronological(d)
        train = fe.series_lags(fe.rolling_multi(x.where(F.col("split") == "train")))
        train = cut_lineage(train.select("*", F.month("ds").alias("order_month"), F.weekday("ds").alias("order_day_of_week"),
                                         (F.weekday("ds") >= 5).cast("int").alias("is_weekend")))
        mat = md.feature_matrix(train, _SCORE_FEATURES, keep=["customer_id", "product_id", "ds"])
        return md.train_counts(mat, _SCORE_FEATURES)

    last = d.agg(F.max("ds")).scalar()
    return md.score_range(fitted(spark, sf_dir, "range model", build), d, F.date_add(last, 1), F.date_add(last, 14), _SCORE_FEATURES)


@query("score_range", with_views(f"WITH {_GRID} SELECT {KEYS}, ds, true AS near_history FROM g", "daily_series"))
def score_range(spark, sf_dir):
    """Every recent series on every day of the range, and whether all counts
    together lie within half and one and a half times what the history's mean
    makes of as many rows (a model that says 0, or explodes, does not)."""
    out = _score_range(spark, sf_dir)
    total = out.agg((F.sum("pred_order_qty") / F.count(F.lit(1))).alias("_said"))
    mean = written_series(spark, sf_dir).agg(F.avg("order_qty").alias("_mean"))
    return (beside(beside(out, total), mean)
            .select("customer_id", "product_id", "ds", (F.col("_said") / F.col("_mean")).between(0.5, 1.5).alias("near_history")))


@query("score_range_rows")
def score_range_rows(spark, sf_dir):
    """The predicted count of every recent series on every day of the range."""
    return _score_range(spark, sf_dir)
