"""Per-series and per-dimension demand profiles.

The reference answers these for one requested series; here every series is
answered in one grouped job and a request is a ``where`` on the result.
Series-ordered statistics use one ``Window.partitionBy(keys).orderBy(ds)``;
a series is bounded by its number of days, so no window partition grows with
the row count of the fact table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import r6, round_to
from .clean import beside, quantiles

K = ["customer_id", "product_id"]
DS = "ds"
Q = "order_qty"
# Weekday names, Monday first.
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _keys(k: Sequence[str] | None) -> list[str]:
    return list(K if k is None else k)


def dow_profile(df: DataFrame, k=None, ds: str = DS, q: str = Q) -> DataFrame:
    """mean, std, count of the quantity per weekday (Mon = 0)."""
    return (df.groupBy(*_keys(k), F.weekday(ds).alias("day_of_week"))
              .agg(r6(F.avg(q)).alias("mean"), r6(F.stddev_samp(q)).alias("std"),
                   F.count(q).alias("count")))


def month_profile(df: DataFrame, k=None, ds: str = DS, q: str = Q) -> DataFrame:
    """mean and count per calendar month."""
    return (df.groupBy(*_keys(k), F.month(ds).alias("month"))
              .agg(r6(F.avg(q)).alias("mean"), F.count(q).alias("count")))


def promo_profile(df: DataFrame, k=None, q: str = Q, flag: str = "is_promotional") -> DataFrame:
    """promo vs base mean, lift % (when both exist and base > 0), promo share %."""
    promo_avg = F.avg(F.when(F.col(flag), F.col(q)))
    base_avg = F.avg(F.when(~F.col(flag), F.col(q)))
    g = df.groupBy(*_keys(k)).agg(promo_avg.alias("promotional_avg"),
                                  base_avg.alias("base_avg"),
                                  (F.count_if(flag) * 100.0 / F.count(F.lit(1)))
                                  .alias("promotional_frequency"))
    lift = F.when(F.col("base_avg") > 0,
                  (F.col("promotional_avg") / F.col("base_avg") - 1) * 100).otherwise(0.0)
    return g.select(*_keys(k),
                    r6("promotional_avg").alias("promotional_avg"), r6("base_avg").alias("base_avg"),
                    F.when(F.col("promotional_avg").isNotNull() & F.col("base_avg").isNotNull(),
                           r6(lift)).alias("promotional_lift"),
                    r6("promotional_frequency").alias("promotional_frequency"))


def history_stats(df: DataFrame, k=None, ds: str = DS, q: str = Q) -> DataFrame:
    """rows, mean, min, max, std and date range per series."""
    return df.groupBy(*_keys(k)).agg(
        F.count(F.lit(1)).alias("total_records"), r6(F.avg(q)).alias("avg_quantity"),
        F.min(q).alias("min_quantity"), F.max(q).alias("max_quantity"),
        r6(F.stddev_samp(q)).alias("std_quantity"),
        F.min(ds).alias("start_date"), F.max(ds).alias("end_date"))


def _positions(df: DataFrame, k, ds: str) -> DataFrame:
    """Forward and reverse row numbers in date order; n = rn + rd - 1."""
    w = W.partitionBy(*_keys(k)).orderBy(ds)
    wr = W.partitionBy(*_keys(k)).orderBy(F.desc(ds))
    return df.withColumn("_rn", F.row_number().over(w)).withColumn("_rd", F.row_number().over(wr))


def recent_vs_old(df: DataFrame, k=None, ds: str = DS, q: str = Q, min_rows: int = 10,
                  span: int = 30) -> DataFrame:
    """mean of the last m vs the first m rows, m = min(span, n // 2), n >= min_rows."""
    x = _positions(df, k, ds)
    n = F.col("_rn") + F.col("_rd") - 1
    m = F.least(F.lit(span), F.floor(n / 2))
    x = x.withColumn("_m", m).withColumn("_n", n)
    g = (x.where(F.col("_n") >= min_rows)
          .groupBy(*_keys(k))
          .agg(F.avg(F.when(F.col("_rd") <= F.col("_m"), F.col(q))).alias("recent_avg"),
               F.avg(F.when(F.col("_rn") <= F.col("_m"), F.col(q))).alias("older_avg")))
    mag = F.when(F.col("older_avg") > 0,
                 F.abs(F.col("recent_avg") - F.col("older_avg")) / F.col("older_avg") * 100
                 ).otherwise(0.0)
    return g.select(*_keys(k), r6("recent_avg").alias("recent_avg"),
                    r6("older_avg").alias("older_avg"),
                    F.when(F.col("recent_avg") > F.col("older_avg"), "increasing")
                     .otherwise("decreasing").alias("trend_direction"),
                    r6(mag).alias("trend_magnitude"))


def distribution_stats(df: DataFrame, q: str = Q, approx: bool = False,
                       accuracy: int = 10000) -> DataFrame:
    """count, min, median, p90, p95, max, mean, std.

    Exact percentiles are selected within brackets (``clean.quantiles``);
    ``approx=True`` uses a bounded sketch per task instead."""
    ps = [0.5, 0.9, 0.95]
    if approx:
        pct = df.agg(F.percentile_approx(q, ps, accuracy).alias("_p"))
    else:
        pct = quantiles(df, {"_p": F.col(q)}, ps)
    g = beside(df.agg(F.count(q).alias("count"), F.min(q).alias("min"),
                      F.max(q).alias("max"), r6(F.avg(q)).alias("mean"),
                      r6(F.stddev_samp(q)).alias("std")), pct)
    return g.select("count", "min", r6(F.col("_p")[0]).alias("median"),
                    r6(F.col("_p")[1]).alias("p90"), r6(F.col("_p")[2]).alias("p95"),
                    "max", "mean", "std")


def quantity_gate(df: DataFrame, pct: float, min_qty: float, q: str = Q) -> DataFrame:
    """rows at or above the pct-th percentile of q, then at or above min_qty.
    The percentile is one row, computed once."""
    cut = quantiles(df, [q], [pct]).select(F.col(q)[0].alias("_cut"))
    return beside(df.where(F.col(q) >= min_qty), cut).where(F.col(q) >= F.col("_cut")).drop("_cut")


def sort_page(df: DataFrame, by: str = Q, descending: bool = True, page: int = 1,
              size: int = 100, tie: Sequence[str] = (DS,) + tuple(K)) -> DataFrame:
    """one page of the sorted table plus the total row count.

    ``orderBy().offset().limit()`` keeps at most page*size rows per task."""
    order = [F.desc(by) if descending else F.asc(by)] + [F.asc(c) for c in tie]
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.orderBy(*order).offset((page - 1) * size).limit(size)
              .withColumn("total_rows", total))


def daily_total(df: DataFrame, ds: str = DS, q: str = Q) -> DataFrame:
    """total per day, with the number of days and the mean per day."""
    per_day = df.groupBy(ds).agg(F.sum(q).alias("total"))
    stats = per_day.agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("m"))
    return per_day.select(ds, "total",
                          stats.select("n").scalar().alias("n_days"),
                          r6(stats.select("m").scalar()).alias("mean_per_day"))


def top_n_others(df: DataFrame, col: str, n: int = 12, q: str = Q) -> DataFrame:
    """total per value; the n largest, then one 'Others' row; zero totals dropped."""
    totals = df.groupBy(col).agg(F.sum(q).alias("total")).where(F.col("total") != 0)
    top = totals.orderBy(F.desc("total"), F.asc(col)).limit(n)
    rest = (totals.join(top.select(col), col, "left_anti")
                  .agg(F.sum("total").alias("total"))
                  .where(F.col("total").isNotNull() & (F.col("total") != 0))
                  .select(F.lit("Others").alias(col), "total"))
    return top.unionByName(rest)


def bucket_monthly(df: DataFrame, k=None, ds: str = DS,
                   cols: Sequence[str] = ("base_demand_qty", "promotional_demand_qty", Q)) -> DataFrame:
    """daily series to calendar months."""
    return (df.groupBy(*_keys(k), F.trunc(ds, "month").alias("period"))
              .agg(*[F.sum(c).alias(c) for c in cols]))


def bucket_weekly(df: DataFrame, k=None, ds: str = DS,
                  cols: Sequence[str] = ("base_demand_qty", "promotional_demand_qty", Q)) -> DataFrame:
    """7-day blocks counted from each series' first day."""
    first = F.min(ds).over(W.partitionBy(*_keys(k)))
    x = df.withColumn("week", F.floor(F.date_diff(F.col(ds), first) / 7).cast("int"))
    return x.groupBy(*_keys(k), "week").agg(F.min(ds).alias("week_start"),
                                            *[F.sum(c).alias(c) for c in cols])


def series_stats(df: DataFrame, k=None, q: str = Q) -> DataFrame:
    """total, mean, min, max per series."""
    return df.groupBy(*_keys(k)).agg(F.sum(q).alias("total"), r6(F.avg(q)).alias("mean"),
                                     F.min(q).alias("min"), F.max(q).alias("max"))


def _r2(c) -> Column:
    return round_to(c, 2)


def profile_by(df: DataFrame, by: str, qty: str = "total_demand_qty") -> DataFrame:
    """F32 (by SKU) / F33 (by channel): mean, std, count of total demand, mean
    base and promo demand, promo frequency %; rounded to 2 places."""
    return df.groupBy(by).agg(
        _r2(F.avg(qty)).alias("avg_total_demand"), _r2(F.stddev_samp(qty)).alias("demand_volatility"),
        F.count(qty).alias("data_points"),
        _r2(F.avg("base_demand_qty")).alias("avg_base_demand"),
        _r2(F.avg("promotional_demand_qty")).alias("avg_promo_demand"),
        (_r2(F.avg(F.col("is_promotional").cast("double"))) * 100).alias("promotional_frequency"))


def profile_by_weekday(df: DataFrame, ds: str = "order_date", qty: str = "total_demand_qty") -> DataFrame:
    """mean and count per day name."""
    return (df.groupBy(F.date_format(ds, "EEEE").alias("day_of_week"))
              .agg(_r2(F.avg(qty)).alias("avg_demand"), F.count(qty).alias("data_points")))


def profile_promo_vs_base(df: DataFrame, qty: str = "total_demand_qty") -> DataFrame:
    """mean total/base/promo demand and count by the promo flag."""
    return (df.groupBy(F.when(F.col("is_promotional"), "promotional").otherwise("base")
                       .alias("period_type"))
              .agg(_r2(F.avg(qty)).alias("avg_total_demand"),
                   _r2(F.avg("base_demand_qty")).alias("avg_base_demand"),
                   _r2(F.avg("promotional_demand_qty")).alias("avg_promo_demand"),
                   F.count(qty).alias("data_points")))


def profile_insights(df: DataFrame, ds: str = "order_date", qty: str = "total_demand_qty") -> DataFrame:
    """highest-demand channel and weekday (by rounded mean, ties to the
    smaller name) and the promo lift % from the rounded means."""
    ch = profile_by(df, "channel", qty)
    dow = profile_by_weekday(df, ds, qty)
    pv = profile_promo_vs_base(df, qty)
    best_ch = ch.agg(F.min_by("channel", F.struct(-F.col("avg_total_demand"), F.col("channel")))
                     .alias("c"), F.max("avg_total_demand").alias("v"))
    best_d = dow.agg(F.min_by("day_of_week", F.struct(-F.col("avg_demand"), F.col("day_of_week")))
                     .alias("d"), F.max("avg_demand").alias("v"))
    p = pv.agg(F.max(F.when(F.col("period_type") == "promotional", F.col("avg_total_demand"))).alias("p"),
               F.max(F.when(F.col("period_type") == "base", F.col("avg_total_demand"))).alias("b"))
    lift = F.when(F.col("b") > 0, (F.col("p") / F.col("b") - 1) * 100).otherwise(0.0)
    return p.select(
        best_ch.select("c").scalar().alias("best_channel"),
        best_ch.select("v").scalar().alias("best_channel_avg"),
        best_d.select("d").scalar().alias("best_day"),
        best_d.select("v").scalar().alias("best_day_avg"),
        r6(lift).alias("promotional_lift"))


def category_top_n(df: DataFrame, n: int = 3, cat: str = "category", ds: str = "order_date",
                   qty: str = "total_demand_qty") -> DataFrame:
    """daily totals of the n largest categories (by total)."""
    totals = df.groupBy(cat).agg(F.sum(qty).alias("total"))
    top = totals.orderBy(F.desc("total"), F.asc(cat)).limit(n).select(cat)
    kept = df.join(F.broadcast(top), cat, "left_semi")   # n rows: bounded broadcast
    return kept.groupBy(cat, ds).agg(F.sum(qty).alias("forecast"))


def demand_heatmap(df: DataFrame, y: str = "category", ds: str = "order_date",
                   qty: str = "total_demand_qty", normalize: bool = False) -> DataFrame:
    """summed demand by y x weekday, missing -> 0; columns are the seven
    fixed day names (no data-dependent pivot values)."""
    x = df.withColumn("_dow", F.weekday(ds))
    p = x.groupBy(y).pivot("_dow", list(range(7))).agg(F.sum(qty)).fillna(0)
    cols = [F.col(str(i)).cast("double").alias(DAY_NAMES[i]) for i in range(7)]
    out = p.select(y, *cols)
    if normalize:
        tot = sum(F.col(d) for d in DAY_NAMES)
        out = out.select(y, *[r6(F.when(tot > 0, F.col(d) / tot).otherwise(0.0)).alias(d)
                             for d in DAY_NAMES])
    return out
