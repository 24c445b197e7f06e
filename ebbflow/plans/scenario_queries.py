"""Queries for scenarios (H01-H06, G19, G20) and planner adjustments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import adjust as aj
from ..operators import forecast as fcst
from ..operators import models as md
from ..operators import scenario as sc
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import fitted, query, written_series
from .forecast_queries import _G02_CTE, H, KEYS
from .oracle_views import r, with_views

# The scenario set of the fixtures (neutral, price +10 %, a
# discount read as a multiplier, and a mixed one with out-of-range values).
SCENARIOS = [
    {"scenario_id": "neutral", "price": 1.0, "discount": 1.0, "inflation": 1.0, "temperature": 1.0},
    {"scenario_id": "price_up", "price": 1.1},
    {"scenario_id": "discount_20", "discount": 0.2},
    {"scenario_id": "mixed", "price": 0.9, "discount": -0.1, "inflation": 12.0, "temperature": 0.05},
]


def _values_sql() -> str:
    def v(x):
        return "CAST(NULL AS DOUBLE)" if x is None else f"CAST({float(x)!r} AS DOUBLE)"
    rows = ", ".join(f"('{s['scenario_id']}', {v(s.get('price'))}, {v(s.get('discount'))}, "
                     f"{v(s.get('inflation'))}, {v(s.get('temperature'))})" for s in SCENARIOS)
    return (f"scn AS (SELECT * FROM (VALUES {rows}) t(scenario_id, scn_price, scn_discount, scn_inflation, "
            f"scn_temperature))")


def _clamp(x: str) -> str:
    return f"least(greatest(coalesce({x}, 1.0), 0.1), 10.0)"


_DISC = ("least(greatest(CASE WHEN coalesce(scn_discount, 1.0) > 0 AND coalesce(scn_discount, 1.0) <= 10.0 "
         "THEN coalesce(scn_discount, 1.0) ELSE 1.0 - coalesce(scn_discount, 1.0) END, 0.1), 10.0)")


def _mult_sql(src: str, temperature: bool = True) -> str:
    t = f", {_clamp('scn_temperature')} AS temperature_mult" if temperature else ""
    comb = "1.0 * price_mult * discount_mult * inflation_mult" + (" * temperature_mult" if temperature else "")
    sq = ("0.0 + (price_mult - 1) * (price_mult - 1) + (discount_mult - 1) * (discount_mult - 1) "
          "+ (inflation_mult - 1) * (inflation_mult - 1)"
          + (" + (temperature_mult - 1) * (temperature_mult - 1)" if temperature else ""))
    return f"""
m0 AS (SELECT * EXCLUDE (scn_price, scn_discount, scn_inflation, scn_temperature),
              {_clamp('scn_price')} AS price_mult, {_DISC} AS discount_mult,
              {_clamp('scn_inflation')} AS inflation_mult{t}
       FROM {src} CROSS JOIN scn),
m AS (SELECT *, {comb} AS _comb, sqrt({sq}) AS _int FROM m0)"""


_H01 = f"""
{_G02_CTE}, g02t AS (SELECT *, base_forecast + promotional_forecast AS total_forecast FROM g02),
{_values_sql()}, {_mult_sql('g02t')},
h01 AS (SELECT * EXCLUDE (_comb, _int), {r('_comb')} AS combined_mult, {r('_int')} AS intensity,
               cast(greatest(round_even(total_forecast * _comb, 0), 0.0) AS BIGINT) AS scenario_value,
               0.12 + 0.06 * least(1.0, _int) AS _conf FROM m)"""


@query("scenario_apply", with_views(f"""
WITH {_H01}
SELECT * EXCLUDE (_conf), cast(round_even(scenario_value * (1 + _conf), 0) AS BIGINT) AS upper,
       cast(round_even(scenario_value * (1 - _conf), 0) AS BIGINT) AS lower FROM h01""", "daily_series"))
def scenario_apply(spark, sf_dir):
    base = fcst.daily_base_promo(fx.daily_series(spark, sf_dir), days=H)
    return sc.scenario_apply(base, SCENARIOS)


@query("scenario_delta", with_views(f"""
WITH {_H01}
SELECT scenario_id, {KEYS}, {r('avg(scenario_value - total_forecast)', 2)} AS avg_delta,
       max(scenario_value - total_forecast) AS max_delta, min(scenario_value - total_forecast) AS min_delta
FROM h01 GROUP BY ALL""", "daily_series"))
def scenario_delta(spark, sf_dir):
    base = fcst.daily_base_promo(fx.daily_series(spark, sf_dir), days=H)
    return sc.scenario_delta(sc.scenario_apply(base, SCENARIOS), ["customer_id", "product_id"])


@query("scenario_daily", with_views(f"""
WITH {_values_sql()}, {_mult_sql('daily_series', temperature=False)}
SELECT * EXCLUDE (_comb, _int), greatest(order_qty * _comb, 0.0) AS order_qty_scn,
       {r('_int')} AS intensity, {r('_comb')} AS combined_mult FROM m""", "daily_series"))
def scenario_daily(spark, sf_dir):
    return sc.scenario_daily(fx.daily_series(spark, sf_dir), SCENARIOS)


@query("scenario_mean_multiplier", with_views(f"""
WITH {_G02_CTE}, g02t AS (SELECT *, base_forecast + promotional_forecast AS total_forecast FROM g02),
{_values_sql()},
x AS (SELECT g02t.*, scn.scenario_id,
             CASE WHEN (scn_price IS NOT NULL)::INT + (scn_discount IS NOT NULL)::INT + (scn_inflation IS NOT NULL)::INT
                       + (scn_temperature IS NOT NULL)::INT > 0
                  THEN (0.0 + coalesce(scn_price, 0.0) + coalesce(scn_discount, 0.0) + coalesce(scn_inflation, 0.0)
                        + coalesce(scn_temperature, 0.0))
                       / ((scn_price IS NOT NULL)::INT + (scn_discount IS NOT NULL)::INT + (scn_inflation IS NOT NULL)::INT
                          + (scn_temperature IS NOT NULL)::INT)
                  ELSE 1.0 END AS mm
      FROM g02t CROSS JOIN scn),
y AS (SELECT * EXCLUDE (mm), cast(round_even(total_forecast * mm, 0) AS BIGINT) AS scenario_value FROM x)
SELECT *, cast(floor(scenario_value * 1.2) AS BIGINT) AS upper, cast(floor(scenario_value * 0.8) AS BIGINT) AS lower
FROM y""", "daily_series"))
def scenario_mean_multiplier(spark, sf_dir):
    base = fcst.daily_base_promo(fx.daily_series(spark, sf_dir), days=H)
    return sc.scenario_mean_multiplier(base, SCENARIOS)


_H05 = {"qty_lag_1": 1.1, "qty_roll14": 0.5, "order_month": 2}
_F14 = f"(PARTITION BY {KEYS} ORDER BY ds ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"


@query("scenario_features", with_views(f"""
WITH f AS (SELECT {KEYS}, ds, cast(lag(order_qty, 1) OVER w AS DOUBLE) AS qty_lag_1,
                  {r(f'coalesce(CASE WHEN count(order_qty) OVER {_F14} >= 3 THEN avg(order_qty) OVER {_F14} END, 0.0)')} AS qty_roll14,
                  cast(month(ds) AS DOUBLE) AS order_month, greatest(coalesce(order_qty, 0.0), 0.0) AS label
           FROM daily_series WINDOW w AS (PARTITION BY {KEYS} ORDER BY ds)),
g AS (SELECT {KEYS}, ds, coalesce(qty_lag_1, (SELECT quantile_cont(qty_lag_1, 0.5) FROM f), 0.0) AS qty_lag_1,
             coalesce(qty_roll14, (SELECT quantile_cont(qty_roll14, 0.5) FROM f), 0.0) AS qty_roll14,
             coalesce(order_month, (SELECT quantile_cont(order_month, 0.5) FROM f), 0.0) AS order_month, label FROM f)
SELECT {KEYS}, ds, {r('qty_lag_1 * 1.1')} AS qty_lag_1, {r('qty_roll14 * 0.5')} AS qty_roll14,
       order_month * 2.0 AS order_month, label FROM g""", "daily_series"))
def scenario_features(spark, sf_dir):
    x = md.training_frame(fx.daily_series(spark, sf_dir))
    mat = md.feature_matrix(x, ["qty_lag_1", "qty_roll14", "order_month"],
                            keep=["customer_id", "product_id", "ds"])
    out = sc.scenario_features(mat, _H05)
    return out.withColumns({"qty_lag_1": r6("qty_lag_1"), "qty_roll14": r6("qty_roll14")})


@query("scenario_units", with_views(f"""
WITH u AS (SELECT {KEYS}, avg(order_qty) AS order_qty_units, avg(revenue) AS revenue_dollars, 20.0 AS temperature_c,
                  avg(price) AS price_dollars, avg(discount_percent) AS discount_percent,
                  count_if(is_promotional) * 100.0 / count(*) AS promotion_percent, 2.0 AS inflation_percent
           FROM daily_series GROUP BY ALL)
SELECT {KEYS}, {r('order_qty_units / 1000.0')} AS order_qty, {r('revenue_dollars / 100000.0')} AS revenue,
       {r('1 + (temperature_c - 20) * 0.01')} AS temperature, {r('price_dollars / 100.0')} AS price,
       {r('1 - discount_percent / 100.0')} AS discount, {r('1 + promotion_percent / 100.0')} AS promotion,
       {r('1 + inflation_percent / 100.0')} AS inflation FROM u""", "daily_series"))
def scenario_units(spark, sf_dir):
    d = fx.daily_series(spark, sf_dir)
    u = d.groupBy("customer_id", "product_id").agg(
        F.avg("order_qty").alias("order_qty_units"), F.avg("revenue").alias("revenue_dollars"),
        F.lit(20.0).alias("temperature_c"), F.avg("price").alias("price_dollars"),
        F.avg("discount_percent").alias("discount_percent"),
        (F.count_if("is_promotional") * 100.0 / F.count(F.lit(1))).alias("promotion_percent"),
        F.lit(2.0).alias("inflation_percent"))
    out = sc.scenario_units(u)
    names = ["order_qty", "revenue", "temperature", "price", "discount", "promotion", "inflation"]
    return out.select("customer_id", "product_id", *[r6(c).alias(c) for c in names])


def _scenario_fit(spark, sf_dir):
    """(model, frame with its split) of the rows that the scenario model learns from."""
    def build():
        keys = ["customer_id", "product_id"]
        rows = sc.training_rows(written_series(spark, sf_dir), keys)
        return sc.train_scenario(sc.scenario_training_frame(rows, SCENARIOS, keys))
    return fitted(spark, sf_dir, "scenario model", build)


#: Rows of ``training_rows``: up to the last signal, non-zero ones of series with 200 of them, series that vary.
_LEARNED_FROM = f"""
a AS (SELECT *, max(CASE WHEN coalesce(order_qty, 0) > 0 THEN ds END) OVER (PARTITION BY {KEYS}) AS _last FROM daily_series),
b AS (SELECT *, count_if(coalesce(order_qty, 0) > 0) OVER (PARTITION BY {KEYS}) AS _nz FROM a WHERE _last IS NULL OR ds <= _last),
c AS (SELECT * FROM b WHERE _nz < 200 OR coalesce(order_qty, 0) > 0),
ready AS (SELECT {KEYS} FROM c GROUP BY ALL HAVING coalesce(stddev_samp(coalesce(order_qty, 0)), 0) > 0 AND count(DISTINCT coalesce(order_qty, 0)) >= 5),
lr AS (SELECT c.* FROM c JOIN ready USING (customer_id, product_id))"""


@query("scenario_model", with_views(f"""
WITH {_values_sql()}, {_LEARNED_FROM}, q AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', ds), 0.8) AS q FROM lr)
SELECT CASE WHEN date_diff('day', DATE '1970-01-01', d.ds) <= q.q THEN 'train' ELSE 'test' END AS split,
       s.scenario_id, count(*) AS n, true AS learned
FROM lr d CROSS JOIN scn s CROSS JOIN q GROUP BY ALL""", "daily_series"))
def scenario_model(spark, sf_dir):
    """Rows of every scenario on both sides of the split, and whether the model
    errs less there than always saying the scenario's mean of the training rows
    (on the test side: not over a fifth more)."""
    model, x = _scenario_fit(spark, sf_dir)
    mean = x.where("split = 'train'").groupBy("scenario_id").agg(F.avg("label").alias("_mean"))
    p = md.predict(model, x, clip=True).join(mean, "scenario_id")
    off, naive = F.avg(F.abs(F.col("label") - F.col("prediction"))), F.avg(F.abs(F.col("label") - F.col("_mean")))
    return p.groupBy("split", "scenario_id").agg(
        F.count(F.lit(1)).alias("n"), (off < naive * F.when(F.first("split") == "train", 1.0).otherwise(1.2)).alias("learned"))


@query("scenario_model_rows")
def scenario_model_rows(spark, sf_dir):
    """The prediction of every row of every scenario on both sides of the split."""
    model, x = _scenario_fit(spark, sf_dir)
    return md.predict(model, x, clip=True).select(
        "split", "scenario_id", "customer_id", "product_id", "ds", "label", "prediction")


@query("scenario_model_forecast", with_views(f"""
WITH {_values_sql()}, s AS (SELECT {KEYS}, max(ds) AS last_date FROM daily_series GROUP BY ALL)
SELECT scn.scenario_id, {KEYS}, cast(unnest(generate_series(last_date + 1, last_date + 14, INTERVAL 1 DAY)) AS DATE) AS ds,
       true AS near_history FROM s CROSS JOIN scn""", "daily_series"))
def scenario_model_forecast(spark, sf_dir):
    """Every scenario and series on each of the next 14 days, and whether the
    scenario's forecasts lie, all together, within half and one and a half times
    its mean adjusted demand a day."""
    out = scenario_model_forecast_rows(spark, sf_dir)
    said = out.groupBy("scenario_id").agg(F.avg("forecast").alias("_said"))
    seen = sc.scenario_daily(written_series(spark, sf_dir), SCENARIOS, "order_qty").groupBy("scenario_id").agg(F.avg("order_qty_scn").alias("_seen"))
    near = said.join(seen, "scenario_id").select("scenario_id", (F.col("_said") / F.col("_seen")).between(0.5, 1.5).alias("near_history"))
    return out.join(F.broadcast(near), "scenario_id").select("scenario_id", "customer_id", "product_id", "ds", "near_history")


@query("scenario_model_forecast_rows")
def scenario_model_forecast_rows(spark, sf_dir):
    """Forecast and band of every scenario and series on each of the next 14 days."""
    model, _ = _scenario_fit(spark, sf_dir)
    return sc.score_scenario(model, written_series(spark, sf_dir), SCENARIOS, ["customer_id", "product_id"], days=14)


# ------------------------------------------------------------------ J

_J01 = f"""
j1 AS (SELECT *, CASE WHEN adjustment_type = 'absolute' THEN adjustment_value
                      WHEN adjustment_type = 'percentage' THEN CASE WHEN current_value <> 0
                           THEN current_value * (1 + adjustment_value / 100) ELSE adjustment_value END
                      WHEN adjustment_type = 'multiplier' THEN CASE WHEN current_value <> 0
                           THEN current_value * adjustment_value ELSE adjustment_value END END AS _e
       FROM adjustments),
j2 AS (SELECT * EXCLUDE (_e), coalesce(new_forecast_value, _e) AS _nv FROM j1),
j01 AS (SELECT * EXCLUDE (_nv), {r('_nv')} AS new_value, {r('_nv - current_value')} AS change,
               {r('CASE WHEN current_value <> 0 THEN (_nv - current_value) / current_value * 100 END')} AS change_percentage
        FROM j2)"""


@query("apply_adjustments", with_views(f"WITH {_J01} SELECT * FROM j01", "adjustments"))
def apply_adjustments(spark, sf_dir):
    return aj.apply_adjustments(fx.adjustments(spark, sf_dir))


def _sku_daily(spark, sf_dir):
    return (fx.demand_history(spark, sf_dir).groupBy("sku_id", F.col("order_date").alias("ds"))
            .agg(F.sum("total_demand_qty").alias("order_qty")))


def _master(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sku_id"),
        F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"))


@query("adjustment_review", with_views(f"""
WITH {_J01},
sd AS (SELECT sku_id, order_date AS ds, sum(total_demand_qty) AS order_qty FROM demand_history GROUP BY ALL),
hs AS (SELECT sku_id, count(*) AS total_records, {r('avg(order_qty)')} AS avg_quantity FROM sd GROUP BY sku_id),
t AS (SELECT DISTINCT sku_id, target_date FROM j01),
pb AS (SELECT DISTINCT sku_id, isodow(target_date) - 1 AS _tdow, month(target_date) AS _tmon FROM t),
x AS (SELECT sd.*, pb._tdow, pb._tmon,
             row_number() OVER (PARTITION BY sd.sku_id, pb._tdow, pb._tmon ORDER BY sd.ds DESC) AS _rd,
             row_number() OVER (PARTITION BY sd.sku_id, pb._tdow, pb._tmon, isodow(sd.ds) ORDER BY sd.ds DESC) AS _rdd
      FROM sd JOIN pb ON sd.sku_id = pb.sku_id),
g AS (SELECT sku_id, _tdow, _tmon, count(*) AS n, avg(order_qty) AS mean_all,
             count_if(isodow(ds) - 1 = _tdow) AS n_dow,
             avg(CASE WHEN isodow(ds) - 1 = _tdow AND _rdd <= 6 THEN order_qty END) AS recent_dow,
             avg(CASE WHEN isodow(ds) - 1 = _tdow AND _rdd > 6 THEN order_qty END) AS older_dow,
             count_if(month(ds) = _tmon) AS n_month, avg(CASE WHEN month(ds) = _tmon THEN order_qty END) AS month_avg,
             avg(CASE WHEN _rd <= 30 THEN order_qty END) AS m30, avg(CASE WHEN _rd <= 7 THEN order_qty END) AS m7,
             avg(CASE WHEN _rd > 7 AND _rd <= 14 THEN order_qty END) AS m8_14
      FROM x GROUP BY ALL),
c AS (SELECT *, CASE WHEN n_dow > 6 THEN older_dow ELSE recent_dow END AS older FROM g),
f AS (SELECT sku_id, _tdow, _tmon, {r('''coalesce(
        CASE WHEN n_dow >= 3 THEN CASE WHEN older > 0 THEN recent_dow * least(greatest(recent_dow / older, 0.5), 2.0) ELSE recent_dow END END,
        CASE WHEN n_month >= 5 AND m30 > 0 THEN m30 * month_avg / mean_all END,
        CASE WHEN n >= 14 AND m8_14 > 0 THEN m7 * least(greatest(m7 / m8_14, 0.7), 1.5) END, m30)''')} AS system_forecast FROM c),
ms AS (SELECT 'P' || cast(p_partkey AS VARCHAR) AS sku_id, p_name AS product_name, p_brand AS brand FROM part),
pd AS (SELECT lower(trim(product_id)) AS pk, cast(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day,
              coalesce(cast(discount AS DOUBLE), 0.0) AS disc FROM promo_calendar),
pm AS (SELECT pk, day, max(disc) AS promo_discount FROM pd GROUP BY ALL)
SELECT j01.adjustment_id, j01.sku_id, j01.target_date, j01.adjustment_type, j01.current_value, j01.new_value,
       hs.total_records IS NOT NULL AS sku_has_history, coalesce(hs.total_records, 0) AS historical_data_points,
       hs.avg_quantity, ms.product_name, ms.brand, pm.pk IS NOT NULL AS active_promotion, pm.promo_discount,
       f.system_forecast, {r('j01.current_value - f.system_forecast')} AS user_input_vs_system,
       {r('j01.new_value - f.system_forecast')} AS adjustment_vs_system,
       CASE WHEN f.system_forecast IS NOT NULL THEN CASE WHEN coalesce(hs.total_records, 0) > 50 THEN 'high' ELSE 'medium' END END
         AS system_confidence
FROM j01 LEFT JOIN hs ON j01.sku_id = hs.sku_id LEFT JOIN ms ON j01.sku_id = ms.sku_id
LEFT JOIN f ON j01.sku_id = f.sku_id AND isodow(j01.target_date) - 1 = f._tdow AND month(j01.target_date) = f._tmon
LEFT JOIN pm ON lower(trim(ms.brand)) = pm.pk AND j01.target_date = pm.day""",
    "adjustments", "demand_history", "promo_calendar"))
def adjustment_review(spark, sf_dir):
    return aj.adjustment_review(fx.adjustments(spark, sf_dir), _sku_daily(spark, sf_dir),
                                _master(spark, sf_dir), fx.promo_calendar(spark, sf_dir))


#: The place that an adjustment names: every third one a channel, every second one a location, every seventh an unknown one.
_PLACED = """
ja AS (SELECT *, CASE WHEN adjustment_id % 3 = 0 THEN 'MACHINERY' WHEN adjustment_id % 7 = 0 THEN 'STALL' ELSE '*' END AS ch,
              CASE WHEN adjustment_id % 2 = 0 THEN 'NATION_' || cast(adjustment_id % 25 AS VARCHAR) ELSE '*' END AS lo FROM j01)"""


@query("adjustment_review_by_place", with_views(f"""
WITH {_J01}, {_PLACED},
fine AS (SELECT sku_id, channel, location, order_date AS ds, sum(total_demand_qty) AS order_qty FROM demand_history GROUP BY ALL),
sd AS (SELECT sku_id, CASE WHEN any_ch THEN '*' ELSE channel END AS ch, CASE WHEN any_lo THEN '*' ELSE location END AS lo, ds, sum(order_qty) AS order_qty
       FROM fine, (VALUES (true), (false)) a(any_ch), (VALUES (true), (false)) b(any_lo) GROUP BY ALL),
hs AS (SELECT sku_id, ch, lo, count(*) AS total_records, {r('avg(order_qty)')} AS avg_quantity FROM sd GROUP BY ALL),
t AS (SELECT DISTINCT sku_id, ch, lo, target_date FROM ja),
pb AS (SELECT DISTINCT sku_id, ch, lo, isodow(target_date) - 1 AS _tdow, month(target_date) AS _tmon FROM t),
x AS (SELECT sd.*, pb._tdow, pb._tmon,
             row_number() OVER (PARTITION BY sd.sku_id, sd.ch, sd.lo, pb._tdow, pb._tmon ORDER BY sd.ds DESC) AS _rd,
             row_number() OVER (PARTITION BY sd.sku_id, sd.ch, sd.lo, pb._tdow, pb._tmon, isodow(sd.ds) ORDER BY sd.ds DESC) AS _rdd
      FROM sd JOIN pb ON sd.sku_id = pb.sku_id AND sd.ch = pb.ch AND sd.lo = pb.lo),
g AS (SELECT sku_id, ch, lo, _tdow, _tmon, count(*) AS n, avg(order_qty) AS mean_all,
             count_if(isodow(ds) - 1 = _tdow) AS n_dow,
             avg(CASE WHEN isodow(ds) - 1 = _tdow AND _rdd <= 6 THEN order_qty END) AS recent_dow,
             avg(CASE WHEN isodow(ds) - 1 = _tdow AND _rdd > 6 THEN order_qty END) AS older_dow,
             count_if(month(ds) = _tmon) AS n_month, avg(CASE WHEN month(ds) = _tmon THEN order_qty END) AS month_avg,
             avg(CASE WHEN _rd <= 30 THEN order_qty END) AS m30, avg(CASE WHEN _rd <= 7 THEN order_qty END) AS m7,
             avg(CASE WHEN _rd > 7 AND _rd <= 14 THEN order_qty END) AS m8_14
      FROM x GROUP BY ALL),
c AS (SELECT *, CASE WHEN n_dow > 6 THEN older_dow ELSE recent_dow END AS older FROM g),
f AS (SELECT sku_id, ch, lo, _tdow, _tmon, {r('''coalesce(
        CASE WHEN n_dow >= 3 THEN CASE WHEN older > 0 THEN recent_dow * least(greatest(recent_dow / older, 0.5), 2.0) ELSE recent_dow END END,
        CASE WHEN n_month >= 5 AND m30 > 0 THEN m30 * month_avg / mean_all END,
        CASE WHEN n >= 14 AND m8_14 > 0 THEN m7 * least(greatest(m7 / m8_14, 0.7), 1.5) END, m30)''')} AS system_forecast FROM c),
ms AS (SELECT 'P' || cast(p_partkey AS VARCHAR) AS sku_id, p_name AS product_name, p_brand AS brand FROM part),
pd AS (SELECT lower(trim(product_id)) AS pk, cast(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day,
              coalesce(cast(discount AS DOUBLE), 0.0) AS disc FROM promo_calendar),
pm AS (SELECT pk, day, max(disc) AS promo_discount FROM pd GROUP BY ALL),
hv AS (SELECT ja.*, ja.sku_id IN (SELECT sku_id FROM demand_history) AS has_sku,
              ja.ch = '*' OR ja.ch IN (SELECT channel FROM demand_history) AS has_ch,
              ja.lo = '*' OR ja.lo IN (SELECT location FROM demand_history) AS has_lo FROM ja)
SELECT hv.adjustment_id, hv.sku_id, hv.ch AS channel, hv.lo AS location, hv.target_date, hv.adjustment_type, hv.current_value, hv.new_value,
       hs.total_records IS NOT NULL AS sku_has_history, coalesce(hs.total_records, 0) AS historical_data_points,
       hs.avg_quantity, ms.product_name, ms.brand, pm.pk IS NOT NULL AS active_promotion, pm.promo_discount,
       f.system_forecast, {r('hv.current_value - f.system_forecast')} AS user_input_vs_system,
       {r('hv.new_value - f.system_forecast')} AS adjustment_vs_system,
       CASE WHEN f.system_forecast IS NOT NULL THEN CASE WHEN coalesce(hs.total_records, 0) > 50 THEN 'high' ELSE 'medium' END END
         AS system_confidence,
       concat_ws('|', CASE WHEN NOT has_sku THEN 'SKU ' || hv.sku_id || ' not found in historical data' END,
                 CASE WHEN NOT has_lo THEN 'Location ' || hv.lo || ' not found in historical data' END,
                 CASE WHEN NOT has_ch THEN 'Channel ' || hv.ch || ' not found in historical data' END,
                 CASE WHEN hs.total_records IS NULL THEN 'No historical data for exact combination: SKU=' || hv.sku_id || ', Channel='
                   || replace(hv.ch, '*', '') || ', Location=' || replace(hv.lo, '*', '') END,
                 CASE WHEN ms.sku_id IS NULL THEN 'SKU ' || hv.sku_id || ' not found in master catalog' END) AS warnings
FROM hv LEFT JOIN hs ON hv.sku_id = hs.sku_id AND hv.ch = hs.ch AND hv.lo = hs.lo LEFT JOIN ms ON hv.sku_id = ms.sku_id
LEFT JOIN f ON hv.sku_id = f.sku_id AND hv.ch = f.ch AND hv.lo = f.lo AND isodow(hv.target_date) - 1 = f._tdow AND month(hv.target_date) = f._tmon
LEFT JOIN pm ON lower(trim(ms.brand)) = pm.pk AND hv.target_date = pm.day""",
    "adjustments", "demand_history", "promo_calendar"))
def adjustment_review_by_place(spark, sf_dir):
    i = F.col("adjustment_id")
    adj = (fx.adjustments(spark, sf_dir)
           .withColumn("channel", F.when(i % 3 == 0, "MACHINERY").when(i % 7 == 0, "STALL"))
           .withColumn("location", F.when(i % 2 == 0, F.concat(F.lit("NATION_"), (i % 25).cast("string"))).otherwise("")))
    out = aj.adjustment_review_by_place(adj, fx.demand_history(spark, sf_dir), _master(spark, sf_dir), fx.promo_calendar(spark, sf_dir))
    return out.drop("recommendations")      # tests compare them with J05 of the series


@query("adjustment_history", with_views("""
SELECT * FROM adjustments
WHERE sku_id = 'P7' AND created_at >= (SELECT max(created_at) FROM adjustments) - INTERVAL 30 DAY
ORDER BY created_at DESC, adjustment_id DESC LIMIT 50""", "adjustments"))
def adjustment_history(spark, sf_dir):
    return aj.adjustment_history(fx.adjustments(spark, sf_dir), {"sku_id": "P7"}, days=30, n=50)


@query("adjustment_summary", with_views(f"""
WITH {_J01}
SELECT count(*) AS total_adjustments, {r('avg(new_value - current_value)')} AS avg_change,
       count_if(new_value - current_value > 0) AS positive_adjustments,
       count_if(new_value - current_value < 0) AS negative_adjustments,
       (SELECT reason_category FROM (SELECT reason_category, count(*) AS c FROM j01 GROUP BY 1)
        ORDER BY c DESC, reason_category LIMIT 1) AS most_common_reason
FROM j01""", "adjustments"))
def adjustment_summary(spark, sf_dir):
    return aj.adjustment_summary(fx.adjustments(spark, sf_dir))


@query("adjustment_advice", with_views(f"""
WITH hs AS (SELECT {KEYS}, avg(order_qty) AS ov, max(ds) AS end_date FROM daily_series GROUP BY ALL),
ov AS (SELECT {KEYS}, {r('avg(order_qty)')} AS avg_quantity, max(ds) AS end_date FROM daily_series GROUP BY ALL),
x0 AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ds) AS rn,
              row_number() OVER (PARTITION BY {KEYS} ORDER BY ds DESC) AS rd FROM daily_series),
x1 AS (SELECT *, rn + rd - 1 AS n, least(30, floor((rn + rd - 1) / 2)) AS m FROM x0),
tr AS (SELECT {KEYS}, avg(CASE WHEN rd <= m THEN order_qty END) AS ra, avg(CASE WHEN rn <= m THEN order_qty END) AS oa
       FROM x1 WHERE n >= 10 GROUP BY ALL),
tr2 AS (SELECT {KEYS}, CASE WHEN ra > oa THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
               {r('CASE WHEN oa > 0 THEN abs(ra - oa) / oa * 100 ELSE 0.0 END')} AS trend_magnitude FROM tr),
pp0 AS (SELECT {KEYS}, avg(CASE WHEN is_promotional THEN order_qty END) AS p,
               avg(CASE WHEN NOT is_promotional THEN order_qty END) AS b FROM daily_series GROUP BY ALL),
pp AS (SELECT {KEYS}, CASE WHEN p IS NOT NULL AND b IS NOT NULL THEN
         {r('CASE WHEN b > 0 THEN (p / b - 1) * 100 ELSE 0.0 END')} END AS promotional_lift FROM pp0),
dw AS (SELECT {KEYS}, isodow(ds) - 1 AS day_of_week, {r('avg(order_qty)')} AS dow_avg, count(order_qty) AS dow_n
       FROM daily_series GROUP BY ALL),
j AS (SELECT ov.*, dw.dow_avg, dw.dow_n, tr2.trend_direction, tr2.trend_magnitude, pp.promotional_lift
      FROM ov LEFT JOIN dw ON ov.customer_id = dw.customer_id AND ov.product_id = dw.product_id
                           AND isodow(ov.end_date + 1) - 1 = dw.day_of_week
      LEFT JOIN tr2 ON ov.customer_id = tr2.customer_id AND ov.product_id = tr2.product_id
      LEFT JOIN pp ON ov.customer_id = pp.customer_id AND ov.product_id = pp.product_id),
k AS (SELECT *, coalesce(trend_magnitude, 0.0) > 20 AS trend_flag,
             coalesce(dow_n, 0) >= 3 AND avg_quantity > 0 AND abs(dow_avg - avg_quantity) / avg_quantity > 0.15 AS dow_flag,
             coalesce(promotional_lift, 0.0) > 20 AS lift_flag FROM j)
SELECT {KEYS}, trend_flag, dow_flag, lift_flag,
       concat_ws(' | ',
         CASE WHEN trend_flag THEN 'Strong ' || trend_direction || ' trend detected (' || cast({r('trend_magnitude', 1)} AS VARCHAR) || '% change)' END,
         CASE WHEN dow_flag THEN 'Day-of-week pattern: ' || cast({r('dow_avg', 1)} AS VARCHAR) || ' vs overall avg ' || cast({r('avg_quantity', 1)} AS VARCHAR) END,
         CASE WHEN lift_flag THEN 'Historical promotional lift: ' || cast({r('promotional_lift', 1)} AS VARCHAR) || '%' END)
         AS recommendations
FROM k""", "daily_series"))
def adjustment_advice(spark, sf_dir):
    return aj.adjustment_advice(fx.daily_series(spark, sf_dir))
