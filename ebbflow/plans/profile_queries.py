"""Queries for the profile operators."""

from __future__ import annotations

from ..operators import profiles as pr
from ..sources import fixtures as fx
from . import query
from .oracle_views import r, with_views

KEYS = "customer_id, product_id"


def _ds(sql: str) -> str:
    return with_views(sql, "daily_series")


def _dh(sql: str) -> str:
    return with_views(sql, "demand_history")


@query("dow_profile", _ds(f"""
SELECT {KEYS}, isodow(ds) - 1 AS day_of_week, {r('avg(order_qty)')} AS mean,
       {r('stddev_samp(order_qty)')} AS std, count(order_qty) AS count
FROM daily_series GROUP BY ALL"""))
def dow_profile(spark, sf_dir):
    return pr.dow_profile(fx.daily_series(spark, sf_dir))


@query("month_profile", _ds(f"""
SELECT {KEYS}, month(ds) AS month, {r('avg(order_qty)')} AS mean, count(order_qty) AS count
FROM daily_series GROUP BY ALL"""))
def month_profile(spark, sf_dir):
    return pr.month_profile(fx.daily_series(spark, sf_dir))


@query("promo_profile", _ds(f"""
WITH g AS (SELECT {KEYS}, avg(CASE WHEN is_promotional THEN order_qty END) AS p,
                  avg(CASE WHEN NOT is_promotional THEN order_qty END) AS b,
                  count_if(is_promotional) * 100.0 / count(*) AS f
           FROM daily_series GROUP BY ALL)
SELECT {KEYS}, {r('p')} AS promotional_avg, {r('b')} AS base_avg,
       CASE WHEN p IS NOT NULL AND b IS NOT NULL THEN
         {r('CASE WHEN b > 0 THEN (p / b - 1) * 100 ELSE 0.0 END')} END AS promotional_lift,
       {r('f')} AS promotional_frequency
FROM g"""))
def promo_profile(spark, sf_dir):
    return pr.promo_profile(fx.daily_series(spark, sf_dir))


@query("history_stats", _ds(f"""
SELECT {KEYS}, count(*) AS total_records, {r('avg(order_qty)')} AS avg_quantity,
       min(order_qty) AS min_quantity, max(order_qty) AS max_quantity,
       {r('stddev_samp(order_qty)')} AS std_quantity, min(ds) AS start_date, max(ds) AS end_date
FROM daily_series GROUP BY ALL"""))
def history_stats(spark, sf_dir):
    return pr.history_stats(fx.daily_series(spark, sf_dir))


@query("recent_vs_old", _ds(f"""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ds) AS rn,
                     row_number() OVER (PARTITION BY {KEYS} ORDER BY ds DESC) AS rd
           FROM daily_series),
y AS (SELECT *, rn + rd - 1 AS n, least(30, floor((rn + rd - 1) / 2)) AS m FROM x),
g AS (SELECT {KEYS}, avg(CASE WHEN rd <= m THEN order_qty END) AS ra,
             avg(CASE WHEN rn <= m THEN order_qty END) AS oa
      FROM y WHERE n >= 10 GROUP BY ALL)
SELECT {KEYS}, {r('ra')} AS recent_avg, {r('oa')} AS older_avg,
       CASE WHEN ra > oa THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
       {r('CASE WHEN oa > 0 THEN abs(ra - oa) / oa * 100 ELSE 0.0 END')} AS trend_magnitude
FROM g"""))
def recent_vs_old(spark, sf_dir):
    return pr.recent_vs_old(fx.daily_series(spark, sf_dir))


@query("distribution_stats", _ds(f"""
SELECT count(order_qty) AS count, min(order_qty) AS min,
       {r('quantile_cont(order_qty, 0.5)')} AS median, {r('quantile_cont(order_qty, 0.9)')} AS p90,
       {r('quantile_cont(order_qty, 0.95)')} AS p95, max(order_qty) AS max,
       {r('avg(order_qty)')} AS mean, {r('stddev_samp(order_qty)')} AS std
FROM daily_series"""))
def distribution_stats(spark, sf_dir):
    return pr.distribution_stats(fx.daily_series(spark, sf_dir))


@query("quantity_gate", _ds("""
SELECT * FROM daily_series
WHERE order_qty >= (SELECT quantile_cont(order_qty, 0.75) FROM daily_series) AND order_qty >= 50"""))
def quantity_gate(spark, sf_dir):
    return pr.quantity_gate(fx.daily_series(spark, sf_dir), 0.75, 50)


@query("sort_page", _ds(f"""
SELECT *, (SELECT count(*) FROM daily_series) AS total_rows FROM daily_series
ORDER BY order_qty DESC, ds, {KEYS} LIMIT 100 OFFSET 200"""))
def sort_page(spark, sf_dir):
    return pr.sort_page(fx.daily_series(spark, sf_dir), page=3, size=100)


@query("daily_total", _ds(f"""
WITH d AS (SELECT ds, sum(order_qty) AS total FROM daily_series GROUP BY ds)
SELECT ds, total, (SELECT count(*) FROM d) AS n_days,
       (SELECT {r('avg(total)')} FROM d) AS mean_per_day FROM d"""))
def daily_total(spark, sf_dir):
    return pr.daily_total(fx.daily_series(spark, sf_dir))


@query("top_n_others", _dh("""
WITH t AS (SELECT sku_id, sum(total_demand_qty) AS total FROM demand_history GROUP BY sku_id
           HAVING sum(total_demand_qty) <> 0),
top AS (SELECT * FROM t ORDER BY total DESC, sku_id LIMIT 12)
SELECT sku_id, total FROM top
UNION ALL
SELECT 'Others', sum(total) FROM t WHERE sku_id NOT IN (SELECT sku_id FROM top)
HAVING sum(total) IS NOT NULL AND sum(total) <> 0"""))
def top_n_others(spark, sf_dir):
    return pr.top_n_others(fx.demand_history(spark, sf_dir), "sku_id", 12, q="total_demand_qty")


_BUCKET_SUMS = ("sum(base_demand_qty) AS base_demand_qty, "
                "sum(promotional_demand_qty) AS promotional_demand_qty, sum(order_qty) AS order_qty")


@query("bucket_monthly", _ds(f"""
SELECT {KEYS}, cast(date_trunc('month', ds) AS DATE) AS period, {_BUCKET_SUMS}
FROM daily_series GROUP BY ALL"""))
def bucket_monthly(spark, sf_dir):
    return pr.bucket_monthly(fx.daily_series(spark, sf_dir))


@query("bucket_weekly", _ds(f"""
WITH x AS (SELECT *, cast(floor(date_diff('day', min(ds) OVER (PARTITION BY {KEYS}), ds) / 7) AS INTEGER) AS week
           FROM daily_series)
SELECT {KEYS}, week, min(ds) AS week_start, {_BUCKET_SUMS} FROM x GROUP BY ALL"""))
def bucket_weekly(spark, sf_dir):
    return pr.bucket_weekly(fx.daily_series(spark, sf_dir))


@query("series_stats", _ds(f"""
SELECT {KEYS}, sum(order_qty) AS total, {r('avg(order_qty)')} AS mean,
       min(order_qty) AS min, max(order_qty) AS max FROM daily_series GROUP BY ALL"""))
def series_stats(spark, sf_dir):
    return pr.series_stats(fx.daily_series(spark, sf_dir))


def _profile_sql(by: str) -> str:
    return _dh(f"""
SELECT {by}, {r('avg(total_demand_qty)', 2)} AS avg_total_demand,
       {r('stddev_samp(total_demand_qty)', 2)} AS demand_volatility,
       count(total_demand_qty) AS data_points,
       {r('avg(base_demand_qty)', 2)} AS avg_base_demand,
       {r('avg(promotional_demand_qty)', 2)} AS avg_promo_demand,
       {r('avg(cast(is_promotional AS DOUBLE))', 2)} * 100 AS promotional_frequency
FROM demand_history GROUP BY {by}""")


@query("profile_by_sku", _profile_sql("sku_id"))
def profile_by_sku(spark, sf_dir):
    return pr.profile_by(fx.demand_history(spark, sf_dir), "sku_id")


@query("profile_by_channel", _profile_sql("channel"))
def profile_by_channel(spark, sf_dir):
    return pr.profile_by(fx.demand_history(spark, sf_dir), "channel")


_WEEKDAY_SQL = (f"SELECT dayname(order_date) AS day_of_week, {r('avg(total_demand_qty)', 2)} AS avg_demand, "
                "count(total_demand_qty) AS data_points FROM demand_history GROUP BY 1")


@query("profile_by_weekday", _dh(_WEEKDAY_SQL))
def profile_by_weekday(spark, sf_dir):
    return pr.profile_by_weekday(fx.demand_history(spark, sf_dir))


_PVB_SQL = (f"SELECT CASE WHEN is_promotional THEN 'promotional' ELSE 'base' END AS period_type, "
            f"{r('avg(total_demand_qty)', 2)} AS avg_total_demand, "
            f"{r('avg(base_demand_qty)', 2)} AS avg_base_demand, "
            f"{r('avg(promotional_demand_qty)', 2)} AS avg_promo_demand, "
            "count(total_demand_qty) AS data_points FROM demand_history GROUP BY 1")


@query("profile_promo_vs_base", _dh(_PVB_SQL))
def profile_promo_vs_base(spark, sf_dir):
    return pr.profile_promo_vs_base(fx.demand_history(spark, sf_dir))


@query("profile_insights", _dh(f"""
WITH ch AS (SELECT channel, {r('avg(total_demand_qty)', 2)} AS a FROM demand_history GROUP BY 1),
dw AS ({_WEEKDAY_SQL}),
pv AS ({_PVB_SQL}),
p AS (SELECT max(CASE WHEN period_type = 'promotional' THEN avg_total_demand END) AS p,
             max(CASE WHEN period_type = 'base' THEN avg_total_demand END) AS b FROM pv)
SELECT (SELECT channel FROM ch ORDER BY a DESC, channel LIMIT 1) AS best_channel,
       (SELECT max(a) FROM ch) AS best_channel_avg,
       (SELECT day_of_week FROM dw ORDER BY avg_demand DESC, day_of_week LIMIT 1) AS best_day,
       (SELECT max(avg_demand) FROM dw) AS best_day_avg,
       {r('CASE WHEN b > 0 THEN (p / b - 1) * 100 ELSE 0.0 END')} AS promotional_lift
FROM p"""))
def profile_insights(spark, sf_dir):
    return pr.profile_insights(fx.demand_history(spark, sf_dir))


@query("category_top_n", _dh("""
WITH top AS (SELECT category FROM demand_history GROUP BY category
             ORDER BY sum(total_demand_qty) DESC, category LIMIT 3)
SELECT category, order_date, sum(total_demand_qty) AS forecast FROM demand_history
WHERE category IN (SELECT category FROM top) GROUP BY ALL"""))
def category_top_n(spark, sf_dir):
    return pr.category_top_n(fx.demand_history(spark, sf_dir), 3)


_DAYS = pr.DAY_NAMES


@query("demand_heatmap", _dh(
    "SELECT category, "
    + ", ".join(f"cast(coalesce(sum(CASE WHEN isodow(order_date) - 1 = {i} THEN total_demand_qty END), 0) AS DOUBLE) AS {d}"
                for i, d in enumerate(_DAYS))
    + " FROM demand_history GROUP BY category"))
def demand_heatmap(spark, sf_dir):
    return pr.demand_heatmap(fx.demand_history(spark, sf_dir))
