"""Queries for the cube operators (F01-F18, B16) on demand_history."""

from __future__ import annotations

from ..operators import cube
from ..sources import fixtures as fx
from . import query
from .oracle_views import r, with_views

ADD_SQL = ("cast(sum(total_demand_qty) AS DOUBLE) AS total_demand_qty, "
           "cast(sum(base_demand_qty) AS DOUBLE) AS base_demand_qty, "
           "cast(sum(promotional_demand_qty) AS DOUBLE) AS promotional_demand_qty, "
           "cast(sum(revenue) AS DOUBLE) AS revenue, count(*) AS record_count")


def _level_sql(level: str, where: str = "") -> str:
    dims = ", ".join(cube.LEVELS[level] + ["order_date"])
    return with_views(f"SELECT {dims}, {ADD_SQL} FROM demand_history {where} GROUP BY {dims}",
                      "demand_history")


def _register_level(level: str) -> None:
    @query(f"rollup_{level}", _level_sql(level))
    def _q(spark, sf_dir, level=level):
        return cube.rollup(fx.demand_history(spark, sf_dir), level)


for _lv in cube.LEVELS:
    _register_level(_lv)


_ALL_SETS = ", ".join("(" + ", ".join(cube.LEVELS[lv] + ["order_date"]) + ")" for lv in cube.LEVELS)
_GID = "grouping(brand, sku_id, location, channel, order_date)"


def _label_sql() -> str:
    cols = cube.ALL_DIMS + ["order_date"]
    whens = []
    for lv, dims in cube.LEVELS.items():
        bits = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols)
                   if c not in dims and c != "order_date")
        whens.append(f"WHEN {bits} THEN '{lv}'")
    return f"CASE {_GID} {' '.join(whens)} END AS level"


@query("rollup_all_levels", with_views(
    f"SELECT brand, sku_id, location, channel, order_date, {ADD_SQL}, {_label_sql()} "
    f"FROM demand_history GROUP BY GROUPING SETS ({_ALL_SETS})", "demand_history"))
def rollup_all_levels(spark, sf_dir):
    return cube.rollup_all(fx.demand_history(spark, sf_dir))


@query("metric_policy", with_views(f"""
SELECT brand, location, order_date, {ADD_SQL},
       sum(discount_percent * total_demand_qty) / sum(total_demand_qty) AS discount_percent_w,
       bool_or(is_promotional) AS is_promotional
FROM demand_history GROUP BY brand, location, order_date""".replace(
    "sum(discount_percent * total_demand_qty) / sum(total_demand_qty) AS discount_percent_w",
    r("sum(discount_percent * total_demand_qty) / sum(total_demand_qty)") + " AS discount_percent"),
    "demand_history"))
def metric_policy(spark, sf_dir):
    from ..functions.columns import r6
    out = cube.rollup_policy(fx.demand_history(spark, sf_dir), "brand_location_day")
    return out.withColumn("discount_percent", r6("discount_percent"))


_FILTER_WHERE = ("WHERE channel = 'BUILDING' AND order_date >= DATE '1996-01-01' "
                 "AND order_date <= DATE '1998-12-31' AND NOT is_promotional")


@query("rollup_filtered", _level_sql("brand_location_day", _FILTER_WHERE))
def rollup_filtered(spark, sf_dir):
    return cube.rollup(fx.demand_history(spark, sf_dir), "brand_location_day",
                       filters={"channel": "BUILDING"}, start="1996-01-01", end="1998-12-31",
                       include_promotional=False)


_BLD = ("SELECT brand, location, order_date, sum(total_demand_qty) AS total_demand_qty, "
        "sum(base_demand_qty) AS base_demand_qty, sum(promotional_demand_qty) AS promotional_demand_qty "
        "FROM demand_history GROUP BY 1, 2, 3")


@query("rollup_summary", with_views(f"""
WITH agg AS ({_BLD}),
top AS (SELECT location, count(*) AS n FROM agg GROUP BY location ORDER BY n DESC, location LIMIT 5),
tops AS (SELECT string_agg(location || ':' || cast(n AS VARCHAR), ',' ORDER BY n DESC, location) AS s FROM top)
SELECT count(*) AS total_records, min(order_date) AS start_date, max(order_date) AS end_date,
       date_diff('day', min(order_date), max(order_date)) AS total_days,
       cast(sum(total_demand_qty) AS BIGINT) AS total_demand,
       round_even(avg(total_demand_qty), 0) AS average_daily_demand,
       {r("stddev_samp(total_demand_qty)")} AS demand_volatility,
       cast(min(total_demand_qty) AS BIGINT) AS min_demand,
       cast(max(total_demand_qty) AS BIGINT) AS max_demand,
       cast(sum(promotional_demand_qty) AS BIGINT) AS total_promotional_demand,
       {r("sum(promotional_demand_qty) * 100 / (sum(promotional_demand_qty) + sum(base_demand_qty))")}
         AS promotional_percentage,
       count(DISTINCT location) AS unique_locations,
       (SELECT s FROM tops) AS top_locations
FROM agg""", "demand_history"))
def rollup_summary(spark, sf_dir):
    agg = cube.rollup(fx.demand_history(spark, sf_dir), "brand_location_day")
    return cube.rollup_summary(agg)


@query("drill_values", with_views("""
SELECT DISTINCT cast(sku_id AS VARCHAR) AS value FROM demand_history
WHERE brand = 'Brand#1' AND sku_id IS NOT NULL AND trim(sku_id) <> ''
  AND lower(trim(sku_id)) NOT IN ('nan', 'none')
ORDER BY value LIMIT 50""", "demand_history"))
def drill_values(spark, sf_dir):
    return cube.dimension_values(fx.demand_history(spark, sf_dir), "sku_id", 50,
                                 {"brand": "Brand#1"})


@query("drill_down", with_views(f"""
WITH vals AS (SELECT DISTINCT location AS value FROM demand_history
              WHERE brand = 'Brand#1' AND location IS NOT NULL AND trim(location) <> ''
                AND lower(trim(location)) NOT IN ('nan', 'none')
              ORDER BY value LIMIT 50)
SELECT brand, location, order_date, {ADD_SQL} FROM demand_history
WHERE brand = 'Brand#1' AND location IN (SELECT value FROM vals)
GROUP BY brand, location, order_date""", "demand_history"))
def drill_down(spark, sf_dir):
    return cube.drill_down(fx.demand_history(spark, sf_dir), "brand_day", "brand_location_day",
                           {"brand": "Brand#1"})


@query("drill_options", with_views("""
WITH s AS (
  SELECT count(DISTINCT sku_id) AS n_sku, count(DISTINCT location) AS n_loc,
         count(DISTINCT channel) AS n_ch, count(DISTINCT brand) AS n_brand,
         count(DISTINCT (sku_id, order_date)) AS r_sku,
         count(DISTINCT (brand, location, order_date)) AS r_bl,
         count(DISTINCT (brand, channel, order_date)) AS r_bc,
         count(DISTINCT order_date) AS r_nat
  FROM demand_history),
samp AS (
  SELECT dimension, string_agg(value, '|' ORDER BY value) AS sample_values FROM (
    SELECT 'sku_id' AS dimension, value FROM (SELECT DISTINCT sku_id AS value FROM demand_history ORDER BY 1 LIMIT 3)
    UNION ALL SELECT 'location', value FROM (SELECT DISTINCT location AS value FROM demand_history ORDER BY 1 LIMIT 3)
    UNION ALL SELECT 'channel', value FROM (SELECT DISTINCT channel AS value FROM demand_history ORDER BY 1 LIMIT 3)
    UNION ALL SELECT 'brand', value FROM (SELECT DISTINCT brand AS value FROM demand_history ORDER BY 1 LIMIT 3)
  ) GROUP BY dimension),
o AS (
  SELECT 'down' AS direction, 'sku_day' AS target_level, 'sku_id' AS dimension, n_sku AS distinct_values, r_sku AS row_estimate FROM s
  UNION ALL SELECT 'down', 'brand_location_day', 'location', n_loc, r_bl FROM s
  UNION ALL SELECT 'down', 'brand_channel_day', 'channel', n_ch, r_bc FROM s
  UNION ALL SELECT 'up', 'national_day', 'brand', n_brand, r_nat FROM s)
SELECT o.*, samp.sample_values FROM o LEFT JOIN samp USING (dimension)""", "demand_history"))
def drill_options(spark, sf_dir):
    return cube.drill_options(fx.demand_history(spark, sf_dir), "brand_day")


@query("value_counts", with_views("""
WITH c AS (SELECT sku_id, count(*) AS count FROM demand_history
           WHERE channel = 'AUTOMOBILE' AND sku_id IS NOT NULL GROUP BY sku_id
           ORDER BY count DESC, sku_id LIMIT 100)
SELECT sku_id, count, row_number() OVER (ORDER BY count DESC, sku_id) AS rank FROM c""",
                                  "demand_history"))
def value_counts(spark, sf_dir):
    return cube.value_counts(fx.demand_history(spark, sf_dir), "sku_id", 100,
                             {"channel": "AUTOMOBILE"})


@query("option_search", with_views("""
WITH c AS (SELECT customer, count(*) AS count FROM demand_history
           WHERE contains(lower(customer), '00001') AND customer IS NOT NULL GROUP BY customer
           ORDER BY count DESC, customer LIMIT 20)
SELECT customer, count, row_number() OVER (ORDER BY count DESC, customer) AS rank FROM c""",
                                   "demand_history"))
def option_search(spark, sf_dir):
    return cube.option_search(fx.demand_history(spark, sf_dir), "customer", "00001", 20)


@query("dimension_values", with_views("""
SELECT DISTINCT cast(category AS VARCHAR) AS value FROM demand_history
WHERE category IS NOT NULL AND trim(category) <> '' AND lower(trim(category)) NOT IN ('nan', 'none')
ORDER BY value LIMIT 50""", "demand_history"))
def dimension_values(spark, sf_dir):
    return cube.dimension_values(fx.demand_history(spark, sf_dir), "category", 50)


@query("data_summary", with_views(f"""
SELECT count(*) AS total_records, min(order_date) AS start_date, max(order_date) AS end_date,
       count(DISTINCT sku_id) AS unique_skus, count(DISTINCT channel) AS unique_channels,
       count(DISTINCT location) AS unique_locations,
       count(DISTINCT (sku_id, channel, location)) AS unique_combinations,
       count_if(is_promotional) AS promotional_records,
       count_if(is_promotional) * 100.0 / count(*) AS promotional_percentage
FROM demand_history""", "demand_history"))
def data_summary(spark, sf_dir):
    return cube.data_summary(fx.demand_history(spark, sf_dir))


@query("rollup_quality", with_views(f"""
WITH agg AS (SELECT brand, order_date, {ADD_SQL} FROM demand_history GROUP BY brand, order_date),
s AS (SELECT count(*) AS n, date_diff('day', min(order_date), max(order_date)) AS days,
             (count_if(brand IS NULL) = 0)::INT + (count_if(order_date IS NULL) = 0)::INT
             + (count_if(total_demand_qty IS NULL) = 0)::INT + (count_if(base_demand_qty IS NULL) = 0)::INT
             + (count_if(promotional_demand_qty IS NULL) = 0)::INT + (count_if(revenue IS NULL) = 0)::INT
             + (count_if(record_count IS NULL) = 0)::INT AS complete
      FROM agg),
t AS (SELECT complete * 100.0 / 7 AS comp,
             CASE WHEN days > 0 THEN least(n * 100.0 / days, 100.0) ELSE 100.0 END AS cov,
             days - n AS gaps FROM s)
SELECT comp AS completeness_score, cov AS coverage_score, gaps AS date_gaps,
       (comp + cov) / 2 AS overall_score,
       CASE WHEN cov > 80 THEN 'Good' WHEN cov > 60 THEN 'Fair' ELSE 'Poor' END AS continuity
FROM t""", "demand_history"))
def rollup_quality(spark, sf_dir):
    return cube.rollup_quality(cube.rollup(fx.demand_history(spark, sf_dir), "brand_day"))
