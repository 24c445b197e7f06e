"""Canonical demand views over the driver's star-schema tables.

These are the inputs every operator consumes (see FIXTURES.md section 2):

* ``demand_history``  line grain, canonical demand columns
* ``daily_series``    unique on (customer_id, product_id, ds)
* ``daily_series_dense`` the same on every day of a series' history, zero filled
* ``inventory``       monthly warehouse snapshots per (product_id, city)
* ``promo_calendar``  one promotion interval per part
* ``adjustments``     planner adjustment log derived from ``events``
* ``ids_left`` / ``ids_right``  noisy vs clean product names (crosswalk)
* ``dirty_history``   demand_history with missing-like values and repeats

Scale notes: nation/region are fixed-size dimensions; orders meet customers
at order grain, so the line items are shuffled once, on the order key; AQE
picks broadcasts from measured sizes, no row count is taken beforehand.
A view joins only the tables that its columns need (``demand_history(...,
columns)``).
``daily_series`` meets the part table at line grain and is summed once: few
lines share part, nation and day, so sums at that grain would be one more
shuffle of nearly all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from .tables import read_table

PROMO_DISCOUNT = 0.08          # discount at or above which a line is promotional
LATE_DAYS = 90                 # ship later than this many days = late
SERIES_KEYS = ["customer_id", "product_id"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region (25 rows by construction of the schema)."""
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                           "o_orderpriority")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey",
                                             "c_mktsegment")
    cust = c.join(geography(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    # orders meet customers at order grain first, so the line items are shuffled
    # once (on the order key) instead of twice (order key, then customer)
    oc = o.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return li.join(oc, li.l_orderkey == oc.o_orderkey)


def _line_revenue() -> Column:
    return (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")


def demand_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-grain demand with the canonical column names."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    x = _order_lines(spark, sf_dir).join(p, F.col("l_partkey") == F.col("p_partkey"))
    qty = F.col("l_quantity")
    promo = F.col("l_discount") >= PROMO_DISCOUNT
    odate = F.to_date("o_orderdate")
    return x.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        odate.alias("order_date"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("sku_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("n_name").alias("location"),
        F.col("r_name").alias("city"),
        F.col("c_mktsegment").alias("channel"),
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer"),
        qty.alias("order_qty"),
        qty.alias("total_demand_qty"),
        _line_revenue().alias("revenue"),
        (F.col("l_extendedprice") / qty).alias("price"),
        (F.col("l_discount") * 100).alias("discount_percent"),
        promo.alias("is_promotional"),
        F.when(promo, qty).otherwise(F.lit(0.0)).alias("promotional_demand_qty"),
        F.when(promo, F.lit(0.0)).otherwise(qty).alias("base_demand_qty"),
        (F.to_date("l_shipdate") > F.date_add(odate, LATE_DAYS)).alias("is_late"),
        F.col("o_orderpriority").alias("forecast_version_name"),
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique (customer_id = nation, product_id = brand, ds) daily totals,
    summed in one map-side combined aggregate."""
    qty = F.col("l_quantity")
    promo = F.col("l_discount") >= PROMO_DISCOUNT
    n = F.count(F.lit(1))
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    x = _order_lines(spark, sf_dir).join(p, F.col("l_partkey") == F.col("p_partkey"))
    promo_qty = F.sum(F.when(promo, qty).otherwise(F.lit(0.0)))
    return (x.groupBy(F.col("n_name").alias("customer_id"),
                      F.col("p_brand").alias("product_id"), F.to_date("o_orderdate").alias("ds"))
              .agg(F.sum(qty).alias("order_qty"),
                   F.sum(_line_revenue()).cast("double").alias("revenue"),
                   (F.sum(qty) - promo_qty).alias("base_demand_qty"),
                   promo_qty.alias("promotional_demand_qty"),
                   F.max(promo).alias("is_promotional"),
                   r6(F.sum(F.col("l_extendedprice") / qty) / n).alias("price"),
                   r6(F.sum(F.col("l_discount") * 100) / n).alias("discount_percent"),
                   n.alias("n_lines")))


def daily_series_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_series on every calendar day from a series' first date to the
    last date of all series, qty 0 when absent.

    The calendar is generated per series with ``explode(sequence)`` (a
    generator, no join) from one aggregate; the end date is a scalar subquery.
    """
    d = daily_series(spark, sf_dir)
    first = d.groupBy(*SERIES_KEYS).agg(F.min("ds").alias("_first"))
    last = d.agg(F.max("ds")).scalar()
    grid = first.select(*SERIES_KEYS, F.explode(F.sequence("_first", last)).alias("ds"))
    j = grid.join(d, SERIES_KEYS + ["ds"], "left")
    zero = F.lit(0.0)
    return j.select(
        *SERIES_KEYS, "ds",
        F.coalesce("order_qty", zero).alias("order_qty"),
        F.coalesce("revenue", zero).alias("revenue"),
        F.coalesce("base_demand_qty", zero).alias("base_demand_qty"),
        F.coalesce("promotional_demand_qty", zero).alias("promotional_demand_qty"),
        F.coalesce("is_promotional", F.lit(False)).alias("is_promotional"),
        "price", "discount_percent")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly snapshot per (product_id = brand, city = supplier nation)."""
    li = (_t(spark, sf_dir, "lineitem")
          .groupBy("l_partkey", "l_suppkey",
                   F.trunc(F.to_date("l_shipdate"), "month").alias("snapshot_date"))
          .agg(F.sum("l_quantity").alias("q")))
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sup = s.join(geography(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    x = (li.join(p, li.l_partkey == p.p_partkey)
           .join(sup, F.col("l_suppkey") == F.col("s_suppkey")))
    return (x.groupBy(F.col("p_brand").alias("product_id"), F.col("n_name").alias("city"),
                      "snapshot_date")
              .agg(F.sum("q").alias("warehouse_inventory_qty")))


PROMO_EPOCH = "1995-01-01"


def promo_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One promotion interval per part: grows with the part table."""
    p = _t(spark, sf_dir, "part")
    start = F.date_add(F.lit(PROMO_EPOCH).cast("date"),
                       ((F.col("p_partkey") * 11) % 2400).cast("int"))
    return p.select(
        F.col("p_partkey").alias("promo_id"),
        F.col("p_brand").alias("product_id"),
        start.alias("start_date"),
        # every 20th interval ends before it starts: such a promotion is never active
        F.when(F.col("p_partkey") % 20 == 0, F.date_sub(start, 5))
         .otherwise(F.date_add(start, (F.col("p_size") % 14).cast("int"))).alias("end_date"),
        F.col("p_size").cast("double").alias("discount"))


ADJUSTMENT_TYPES = ("absolute", "percentage", "multiplier")


def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planner adjustment log: one adjustment per event."""
    e = _t(spark, sf_dir, "events")
    kind = (F.when(F.col("event_id") % 3 == 0, F.lit(ADJUSTMENT_TYPES[0]))
             .when(F.col("event_id") % 3 == 1, F.lit(ADJUSTMENT_TYPES[1]))
             .otherwise(F.lit(ADJUSTMENT_TYPES[2])))
    return e.select(
        F.col("event_id").alias("adjustment_id"),
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("sku_id"),
        F.to_date("ts").alias("target_date"),
        F.col("value").alias("current_value"),
        F.when(F.col("event_id") % 7 == 0, F.col("value") * 2).alias("new_forecast_value"),
        kind.alias("adjustment_type"),
        F.get_json_object("props", "$.k").cast("double").alias("adjustment_value"),
        F.col("event_type").alias("reason_category"),
        F.col("ts").alias("created_at"))


def ids_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_name").alias("right_id")).distinct()


def ids_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct product names with case, punctuation, leading-zero noise; one
    variant in four gets an extra trailing letter (one edit away)."""
    n = F.col("p_name")
    variant = F.length(n) % 4
    noisy = (F.when(variant == 0, F.upper(n))
              .when(variant == 1, F.concat(F.lit("  "), n, F.lit(".")))
              .when(variant == 2, F.concat(F.lit("00"), F.regexp_replace(n, " ", "-")))
              .otherwise(F.concat(n, F.lit("s"))))
    return (_t(spark, sf_dir, "part").select(n).distinct()
            .select(noisy.alias("left_id")))


def dirty_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """demand_history with missing-like ids and quantities plus exact repeats.

    Dirt is placed by key arithmetic (no randomness) so any engine builds the
    same rows; repeats are whole extra copies of rows.
    """
    h = demand_history(spark, sf_dir).withColumn(
        "_m", (F.col("order_id").cast("long") * 7 + F.col("line_number")) % 50)
    m = F.col("_m")
    dirty = h.select(
        F.when(m == 0, F.lit(None)).when(m == 1, F.lit("none")).when(m == 2, F.lit("nan"))
         .when(m == 3, F.lit("0")).otherwise(F.col("order_id")).alias("order_id"),
        "line_number",
        F.when(m == 4, F.lit(None).cast("date")).otherwise(F.col("order_date")).alias("order_date"),
        F.when(m == 5, F.lit("")).when(m == 6, F.lit(" NaN ")).when(m == 7, F.lit(None))
         .otherwise(F.col("sku_id")).alias("sku_id"),
        F.when(m == 8, F.lit(None)).otherwise(F.col("category")).alias("category"),
        F.when(m == 9, F.lit("None")).otherwise(F.col("city")).alias("city"),
        F.when(m == 10, F.lit(None)).otherwise(F.col("customer")).alias("customer"),
        "channel", "location",
        F.when(m == 11, F.lit(None).cast("double")).otherwise(F.col("order_qty")).alias("order_qty"),
        F.when(m == 12, F.lit(None).cast("double")).otherwise(F.col("price")).alias("price"),
        "discount_percent", "is_promotional", "_m")
    # one row or two of each: the joins run once
    copies = F.when(m == 13, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return dirty.withColumn("_copy", F.explode(copies)).drop("_m", "_copy")


def backtest(spark: SparkSession, sf_dir: str, by: str = "forecast_version_name") -> DataFrame:
    """G14 applied to daily totals per ``by``: (by, order_date, actual, forecast)."""
    from ..operators.forecast import ma_backtest
    return ma_backtest(demand_history(spark, sf_dir), [by])
