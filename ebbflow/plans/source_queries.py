"""Queries for the source-side operators that have an SQL form (A03-A05,
A07, A10, A13, A14).  File readers and writers (A01, A02, A06, A08, A09,
A11, A12) are exercised against temporary folders in tests/."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as fcst
from ..sources import fixtures as fx
from ..sources import readers as rd
from ..sources import schema as S
from ..sources import sinks as sk
from . import query
from .forecast_queries import _G02_CTE, H, KEYS
from .oracle_views import with_views

# raw headers given to the demand columns (the aliases map them back)
_RAW = [("order_id", "Order Id"), ("order_date", "order date (DateOrders)"),
        ("customer", "Order Customer Id"), ("city", "Order City"), ("location", "location"),
        ("sku_id", "Product Card Id"), ("product_name", "Product Name"), ("category", "Category Name"),
        ("order_qty", "Order Item Quantity"), ("revenue", "Sales"), ("channel", "channel")]


def _raw(spark, sf_dir):
    d = fx.demand_history(spark, sf_dir)
    return d.select(*[(F.col(a).cast("double") if a == "revenue" else F.col(a)).alias(b) for a, b in _RAW])


_RAW_SQL = ("raw AS (SELECT " + ", ".join(
    f"{'cast(' + a + ' AS DOUBLE)' if a == 'revenue' else a} AS \"{b}\"" for a, b in _RAW)
    + " FROM demand_history)")


@query("map_columns", with_views(f"""
WITH {_RAW_SQL}
SELECT "Order Id" AS order_id, "order date (DateOrders)" AS order_date, "Order Customer Id" AS customer_id,
       "Order City" AS city, "Product Card Id" AS product_id, "Product Name" AS product_name,
       "Category Name" AS category, "Order Item Quantity" AS order_qty, "Sales" AS revenue, channel
FROM raw""", "demand_history"))
def map_columns(spark, sf_dir):
    return rd.map_columns(_raw(spark, sf_dir))


def _dirty_text(spark, sf_dir):
    d = fx.dirty_history(spark, sf_dir)
    return d.withColumn("order_date", F.when(F.col("line_number") == 7, F.lit("not a date"))
                        .when(F.col("line_number") == 6, F.date_format("order_date", "M/d/yyyy 'X'"))
                        .when(F.col("line_number") == 5, F.concat(F.date_format("order_date", "M/d/yyyy"), F.lit(" 22:56")))
                        .when(F.col("line_number") == 4, F.date_format("order_date", "MM-dd-yyyy"))
                        .otherwise(F.col("order_date").cast("string")))


# lines 4 to 7 carry dates in other forms, the last two of them bad
_DIRTY_TEXT = ("dt AS (SELECT * REPLACE (CASE line_number WHEN 7 THEN 'not a date' "
               "WHEN 6 THEN strftime(order_date, '%-m/%-d/%Y X') WHEN 5 THEN strftime(order_date, '%-m/%-d/%Y') || ' 22:56' "
               "WHEN 4 THEN strftime(order_date, '%m-%d-%Y') "
               "ELSE cast(order_date AS VARCHAR) END AS order_date) FROM dirty_history)")
_PARSED = ("coalesce(try_cast(order_date AS TIMESTAMP), try_strptime(order_date, ['%m/%d/%Y %H:%M:%S', '%m/%d/%Y %H:%M', "
           "'%m/%d/%Y', '%m-%d-%Y', '%Y/%m/%d']))")


@query("resolve_dates", with_views(f"""
WITH {_DIRTY_TEXT}
SELECT * REPLACE (cast({_PARSED} AS DATE) AS order_date) FROM dt
WHERE {_PARSED} IS NOT NULL""", "dirty_history"))
def resolve_dates(spark, sf_dir):
    x = rd.resolve_dates(_dirty_text(spark, sf_dir))
    return x.withColumn("order_date", F.to_date("order_date"))


def _conform_sql() -> str:
    mapped = {"order_id": '"Order Id"', "order_date": 'cast("order date (DateOrders)" AS DATE)',
              "customer_id": '"Order Customer Id"', "city": '"Order City"', "product_id": '"Product Card Id"',
              "product_name": '"Product Name"', "category": '"Category Name"',
              "order_qty": '"Order Item Quantity"', "revenue": '"Sales"'}
    sel = []
    for c in S.CANONICAL_COLUMNS:
        if c in mapped:
            e = mapped[c]
        elif c == "order_year":
            e = "year(\"order date (DateOrders)\")"
        elif c == "order_month":
            e = "month(\"order date (DateOrders)\")"
        elif c == "order_day":
            e = "day(\"order date (DateOrders)\")"
        elif c == "order_day_of_week":
            e = "isodow(\"order date (DateOrders)\") - 1"
        elif c in S.ZERO_DEFAULT:
            e = "0.0"
        elif c in S.FALSE_DEFAULT:
            e = "false"
        elif c == "forecast_date":
            e = 'cast("order date (DateOrders)" AS DATE)'
        elif c == "location":
            e = '"Order City"'
        else:
            e = "'None'"
        sel.append(f'{e} AS "{c}"')
    return with_views(f"WITH {_RAW_SQL} SELECT " + ", ".join(sel) + " FROM raw", "demand_history")


@query("conform_schema", _conform_sql())
def conform_schema(spark, sf_dir):
    x = rd.conform_schema(rd.resolve_dates(rd.map_columns(_raw(spark, sf_dir))))
    return x.withColumns({"order_date": F.to_date("order_date"), "forecast_date": F.to_date("forecast_date")})


@query("load_demand_history", with_views(f"""
WITH {_DIRTY_TEXT}
SELECT * REPLACE (cast({_PARSED} AS DATE) AS order_date) FROM dt
WHERE {_PARSED} IS NOT NULL""", "dirty_history"))
def load_demand_history(spark, sf_dir):
    return rd.load_demand_history(_dirty_text(spark, sf_dir))


_SAMPLE_KEY = ["order_id", "line_number", "sku_id", "customer_id", "order_date"]


@query("sample_rows", with_views("""
SELECT * FROM demand_history
ORDER BY md5(concat_ws('|', """ + ", ".join(f"cast({c} AS VARCHAR)" for c in _SAMPLE_KEY) + """, '42'))
LIMIT 100""", "demand_history"))
def sample_rows(spark, sf_dir):
    return rd.sample_rows(fx.demand_history(spark, sf_dir), 100, _SAMPLE_KEY, seed=42)


_SUMMARY_FIELDS = ["total_records", "start_date", "end_date", "unique_skus", "unique_channels",
                   "unique_locations", "unique_combinations", "promotional_records", "promotional_percentage"]


@query("export_flat", with_views("""
WITH s AS (SELECT count(*) AS total_records, min(order_date) AS start_date, max(order_date) AS end_date,
                  count(DISTINCT sku_id) AS unique_skus, count(DISTINCT channel) AS unique_channels,
                  count(DISTINCT location) AS unique_locations,
                  count(DISTINCT (sku_id, channel, location)) AS unique_combinations,
                  count_if(is_promotional) AS promotional_records,
                  count_if(is_promotional) * 100.0 / count(*) AS promotional_percentage FROM demand_history)
""" + " UNION ALL ".join(f"SELECT '{f}' AS field, cast({f} AS VARCHAR) AS value FROM s" for f in _SUMMARY_FIELDS),
    "demand_history"))
def export_flat(spark, sf_dir):
    from ..operators.cube import data_summary
    return sk.flatten_record(data_summary(fx.demand_history(spark, sf_dir)))


@query("export_series", with_views(f"""
WITH {_G02_CTE}
SELECT {KEYS}, ds, base_forecast, promotional_forecast, base_forecast + promotional_forecast AS total_forecast
FROM g02""", "daily_series"))
def export_series(spark, sf_dir):
    keys = ["customer_id", "product_id"]
    fc = fcst.daily_base_promo(fx.daily_series(spark, sf_dir), days=H)
    cols = ["ds", "base_forecast", "promotional_forecast", "total_forecast"]
    arrays = fc.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("s")).select(*keys, *[F.col("s")[c].alias(c) for c in cols])
    return sk.export_series(arrays, keys, "ds")
