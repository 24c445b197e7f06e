"""Statistical forecasts per series (G01-G15), noise off.

Input is a table unique on (keys, ds).  Every forecast is computed for all
series at once: per-series statistics come from one conditional aggregate
over a reverse row number (``_rd`` = 1 for the last day), the horizon is
generated per series with ``explode(sequence)``, and weekday / month
profiles are joined on (keys, weekday).  Noise and coin-toss promotions of
the reference are replaced by their expected values (SURVEY section 8).
Integer outputs use Python's half-even rounding (``bround``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import r6

K = ["customer_id", "product_id"]
DS = "ds"
Q = "order_qty"
# Weekday multipliers Monday..Sunday of the roll-up forecast.
DOW_MULTIPLIERS = (0.9, 0.95, 1.0, 1.05, 1.1, 1.2, 1.15)


def _k(k):
    return list(K if k is None else k)


def _clip(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def _round_int(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def tail_stats(df: DataFrame, k=None, ds: str = DS, q: str = Q,
               flag: str | None = None) -> DataFrame:
    """Per-series statistics of the last rows: n, last date, overall mean,
    mean / std of the last 30, mean of the last 7, last 14 and rows 8-14."""
    keys = _k(k)
    rd = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(ds)))
    x = df.withColumn("_rd", rd)
    r = F.col("_rd")
    aggs = [F.count(F.lit(1)).alias("n"), F.max(ds).alias("last_date"), F.avg(q).alias("mean_all"),
            F.avg(F.when(r <= 30, F.col(q))).alias("m30"),
            F.stddev_samp(F.when(r <= 30, F.col(q))).alias("s30"),
            F.avg(F.when(r <= 7, F.col(q))).alias("m7"),
            F.avg(F.when(r <= 14, F.col(q))).alias("m14"),
            F.avg(F.when((r > 7) & (r <= 14), F.col(q))).alias("m8_14")]
    if flag:
        aggs += [F.avg(F.when(~F.col(flag), F.col(q))).alias("base_avg"),
                 F.avg(F.when(F.col(flag), F.col(q))).alias("promo_avg"),
                 F.count_if(flag).alias("promo_days")]
    return x.groupBy(*keys).agg(*aggs)


def _horizon(stats: DataFrame, days: int, ds: str = DS, first_step: int = 0) -> DataFrame:
    """Series x forecast steps; step i forecasts last_date + 1 + i."""
    g = stats.withColumn("step", F.explode(F.sequence(F.lit(first_step), F.lit(first_step + days - 1))))
    return g.withColumn(ds, F.date_add("last_date", F.col("step") + 1 - first_step)) \
            .withColumn("_dow", F.weekday(ds))


def _dow_means(df: DataFrame, k, ds, q) -> DataFrame:
    return df.groupBy(*_k(k), F.weekday(ds).alias("_dow")).agg(F.avg(q).alias("dow_mean"))


def simple_forecast(df: DataFrame, k=None, ds: str = DS, q: str = Q, days: int = 30) -> DataFrame:
    """Weekday mean (else mean of the last 30) + i x (mean last 7 - mean
    last 14) / 7, floor 0; bands x1.2 / x0.8."""
    keys = _k(k)
    st = tail_stats(df, k, ds, q)
    trend = F.when(F.col("n") > 7, (F.col("m7") - F.col("m14")) / 7).otherwise(F.lit(0.0))
    g = _horizon(st.withColumn("trend", trend), days, ds)
    j = g.join(_dow_means(df, k, ds, q), keys + ["_dow"], "left")
    v = F.greatest(F.coalesce("dow_mean", "m30") + F.col("trend") * F.col("step"), F.lit(0.0))
    return j.select(*keys, ds, "step", _round_int(v).alias("forecast"),
                    _round_int(v * 1.2).alias("upper"), _round_int(v * 0.8).alias("lower"))


def daily_base_promo(df: DataFrame, k=None, ds: str = DS, q: str = Q, flag: str = "is_promotional",
                     days: int = 30) -> DataFrame:
    """base = max(10, weekday mean (else base mean) + trend x i);
    promo = base x lift x promo frequency (expected value of the coin toss)."""
    keys = _k(k)
    st = tail_stats(df, k, ds, q, flag)
    base_avg = F.coalesce("base_avg", "mean_all")
    promo_avg = F.coalesce("promo_avg", F.lit(0.0))
    lift = F.when((base_avg > 0) & (promo_avg > 0), _clip(promo_avg / base_avg - 1.0, 0.1, 3.0)) \
            .otherwise(F.lit(0.3))
    freq = F.col("promo_days") / F.col("n")
    trend = F.when((F.col("n") >= 14) & (F.col("m8_14") > 0),
                   (F.col("m7") - F.col("m8_14")) / 7).otherwise(F.lit(0.0))
    st = st.select(*keys, "last_date", base_avg.alias("hist_base_avg"), lift.alias("promo_lift"),
                   freq.alias("promo_frequency"), trend.alias("trend_slope"))
    j = _horizon(st, days, ds).join(_dow_means(df, k, ds, q), keys + ["_dow"], "left")
    b0 = F.greatest(F.coalesce("dow_mean", "hist_base_avg"), F.lit(10.0))
    base = F.greatest(b0 + F.col("trend_slope") * F.col("step"), F.lit(10.0))
    promo = base * F.col("promo_lift") * F.col("promo_frequency")
    out = j.select(*keys, ds, "step", _round_int(base).alias("base_forecast"),
                   _round_int(promo).alias("promotional_forecast"))
    return out.withColumn("total_forecast", F.col("base_forecast") + F.col("promotional_forecast"))


def baseline_band(fc: DataFrame, total: str = "total_forecast") -> DataFrame:
    """Total forecast with +-10 % integer bands (truncated)."""
    return fc.withColumns({"upper": F.floor(F.col(total) * 1.1).cast("long"),
                           "lower": F.floor(F.col(total) * 0.9).cast("long")})


def promo_forecast(df: DataFrame, promo: DataFrame, k=None, ds: str = DS, q: str = Q,
                   flag: str = "is_promotional", product: str = "product_id", days: int = 30) -> DataFrame:
    """Weekday-mean base; promo = base x lift (clipped 0..3, default 0.5)
    on days inside a promotion interval of the series' product."""
    from .joins import promo_days
    from ..functions.columns import norm_text
    keys = _k(k)
    st = tail_stats(df, k, ds, q, flag)
    base_avg = F.coalesce("base_avg", "mean_all")
    lift = F.when(F.col("promo_avg").isNull(), F.lit(0.5)).otherwise(
        _clip(F.when(base_avg > 0, F.col("promo_avg") / base_avg - 1).otherwise(F.lit(0.5)), 0.0, 3.0))
    st = st.select(*keys, "last_date", base_avg.alias("hist_base_avg"), lift.alias("promo_lift"))
    g = _horizon(st, days, ds).join(_dow_means(df, k, ds, q), keys + ["_dow"], "left")
    pdays = promo_days(promo).select("_pk", "_day", F.lit(True).alias("_active"))
    j = g.join(pdays, (norm_text(product) == F.col("_pk")) & (F.col(ds) == F.col("_day")), "left")
    base = F.coalesce("dow_mean", "hist_base_avg")
    pr = F.when(F.col("_active"), base * F.col("promo_lift")).otherwise(F.lit(0.0))
    return j.select(*keys, ds, "step", "promo_lift",
                    _round_int(F.greatest(base, F.lit(0.0))).alias("base_demand_forecast"),
                    _round_int(F.greatest(pr, F.lit(0.0))).alias("promotional_demand_forecast"))


def promo_forecast_summary(fc: DataFrame, hist: DataFrame, k=None, ds: str = DS,
                           flag: str = "is_promotional") -> DataFrame:
    """Totals, promo/base ratio, promo days, lift, historical promo day
    share; ``total_embedded`` is the embedded mode (promo folded into base)."""
    keys = _k(k)
    s = fc.groupBy(*keys).agg(F.sum("base_demand_forecast").alias("total_base"),
                              F.sum("promotional_demand_forecast").alias("total_promo"),
                              F.count_if(F.col("promotional_demand_forecast") > 0).alias("promo_days"),
                              F.max("promo_lift").alias("avg_promotional_lift"))
    h = hist.groupBy(*keys).agg((F.count_if(flag) / F.count(F.lit(1))).alias("hist_promo_frequency"))
    ratio = F.when(F.col("total_base") > 0, F.col("total_promo") / F.col("total_base")).otherwise(F.lit(0.0))
    return s.join(h, keys, "left").select(
        *keys, "total_base", "total_promo", r6(ratio).alias("promo_base_ratio"), "promo_days",
        r6("avg_promotional_lift").alias("avg_promotional_lift"),
        r6("hist_promo_frequency").alias("hist_promo_frequency"),
        (F.col("total_base") + F.col("total_promo")).alias("total_embedded"))


def rollup_forecast(agg: DataFrame, k: Sequence[str], ds: str = "order_date",
                    q: str = "total_demand_qty", days: int = 30) -> DataFrame:
    """Mean of the last 30 + capped trend (+-10 % of it) x step, times a
    weekday factor, floor 1; 95 % band from the last-30 std (20 % of the
    mean when undefined).  Per series of the roll-up level."""
    keys = list(k)
    st = tail_stats(agg, keys, ds, q)
    recent = F.when(F.col("m30") > 0, F.col("m30")).otherwise(F.greatest("mean_all", F.lit(100.0)))
    st = st.withColumn("recent_avg", recent)
    std = F.when(F.col("s30") > 0, F.col("s30")).otherwise(F.col("recent_avg") * 0.2)
    cap = F.col("recent_avg") * 0.1
    slope = F.when((F.col("n") >= 14) & (F.col("m8_14") > 0),
                   F.least(F.greatest((F.col("m7") - F.col("m8_14")) / 7, -cap), cap)).otherwise(F.lit(0.0))
    st = st.withColumn("recent_std", std).withColumn("trend_slope", slope)
    g = _horizon(st, days, ds)
    mult = F.element_at(F.array(*[F.lit(m) for m in DOW_MULTIPLIERS]), F.col("_dow") + 1)
    base = F.greatest((F.col("recent_avg") + F.col("trend_slope") * (F.col("step") + 1)) * mult, F.lit(1.0))
    band = 1.96 * F.col("recent_std")
    return g.select(*keys, ds, "step", _round_int(base).alias("forecast"),
                    _round_int(base + band).alias("upper"),
                    _round_int(F.greatest(base - band, F.lit(0.0))).alias("lower"),
                    r6("trend_slope").alias("trend_slope"))


def current_forecast(df: DataFrame, k=None, ds: str = DS, q: str = Q,
                     targets: DataFrame | None = None) -> DataFrame:
    """One forecast per (series, target date) -- by default the day after
    the series' last date -- by the first rule that applies: weekday mean
    with trend clipped 0.5..2 (>= 3 rows of that weekday); monthly
    seasonality (>= 5 rows of that month); 7-vs-7 trend clipped 0.7..1.5
    (>= 14 rows); mean of the last 30.

    The rules depend on a target only through its weekday and month: the
    history is aggregated per series, per (series, weekday) and per (series,
    month), and the targets are joined to these small tables."""
    keys = _k(k)
    if targets is None:
        t = df.groupBy(*keys).agg(F.date_add(F.max(ds), 1).alias("target_date"))
    else:
        t = targets.select(*keys, "target_date").distinct()
    r, rd, v = F.col("_rd"), F.col("_rdd"), F.col(q)
    x = (df.withColumn("_rd", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(ds))))
           .withColumn("_rdd", F.row_number().over(W.partitionBy(*keys, F.weekday(ds)).orderBy(F.desc(ds)))))
    whole = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean_all"), F.avg(F.when(r <= 30, v)).alias("m30"),
        F.avg(F.when(r <= 7, v)).alias("m7"), F.avg(F.when((r > 7) & (r <= 14), v)).alias("m8_14"))
    by_dow = x.groupBy(*keys, F.weekday(ds).alias("_tdow")).agg(
        F.count(F.lit(1)).alias("n_dow"), F.avg(F.when(rd <= 6, v)).alias("recent_dow"), F.avg(F.when(rd > 6, v)).alias("older_dow"))
    by_month = x.groupBy(*keys, F.month(ds).alias("_tmon")).agg(F.count(F.lit(1)).alias("n_month"), F.avg(v).alias("month_avg"))
    j = (t.withColumn("_tdow", F.weekday("target_date")).withColumn("_tmon", F.month("target_date"))
          .join(whole, keys, "left").join(by_dow, keys + ["_tdow"], "left").join(by_month, keys + ["_tmon"], "left"))
    recent = F.col("recent_dow")
    older = F.when(F.col("n_dow") > 6, F.col("older_dow")).otherwise(recent)
    c1 = F.when(F.col("n_dow") >= 3, F.when(older > 0, recent * _clip(recent / older, 0.5, 2.0))
                .otherwise(recent))
    c2 = F.when((F.col("n_month") >= 5) & (F.col("m30") > 0),
                F.col("m30") * F.col("month_avg") / F.col("mean_all"))
    c3 = F.when((F.col("n") >= 14) & (F.col("m8_14") > 0),
                F.col("m7") * _clip(F.col("m7") / F.col("m8_14"), 0.7, 1.5))
    method = F.when(F.col("n").isNotNull(), F.when(c1.isNotNull(), "day_of_week").when(c2.isNotNull(), "monthly")
                    .when(c3.isNotNull(), "trend").otherwise("recent_average"))
    return j.select(*keys, "target_date", r6(F.coalesce(c1, c2, c3, F.col("m30"))).alias("forecast"), method.alias("method"))


def statistical_baseline(df: DataFrame, k=None, ds: str = DS, q: str = Q, days: int = 30,
                         default: float = 100.0) -> DataFrame:
    """Mean daily total per weekday, projected; 100 for an unseen
    weekday; bands x1.2 / x0.8 truncated."""
    keys = _k(k)
    daily = df.groupBy(*keys, ds).agg(F.sum(q).alias("_q"))
    st = daily.groupBy(*keys).agg(F.max(ds).alias("last_date"))
    dm = daily.groupBy(*keys, F.weekday(ds).alias("_dow")).agg(F.avg("_q").alias("dow_mean"))
    j = _horizon(st, days, ds).join(dm, keys + ["_dow"], "left")
    v = F.greatest(F.bround(F.coalesce("dow_mean", F.lit(default)), 0), F.lit(0.0)).cast("long")
    return j.select(*keys, ds, "step", v.alias("forecast")) \
            .withColumns({"upper": F.floor(F.col("forecast") * 1.2).cast("long"),
                          "lower": F.floor(F.col("forecast") * 0.8).cast("long")})


# ------------------------------------------------------------------ forecast versions

def _version_base(df: DataFrame, k, ds, q) -> DataFrame:
    keys = _k(k)
    target = F.date_add(F.max(ds).over(W.partitionBy(*keys)), 1)
    return (df.withColumn("_t", target)
              .withColumn("_rd", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(ds))))
              .withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(ds)))
              .withColumn("_rdd", F.row_number().over(W.partitionBy(*keys, F.weekday(ds)).orderBy(F.desc(ds))))
              .withColumn("_rnd", F.row_number().over(W.partitionBy(*keys, F.weekday(ds)).orderBy(ds))))


def version_dow_trend(df: DataFrame, k=None, ds: str = DS, q: str = Q) -> DataFrame:
    """Last-3 vs first-3 same-weekday ratio clipped 0.7..1.5 times the
    last-3 mean (>= 6 weekday rows); weekday mean (3..5 rows); else mean."""
    keys = _k(k)
    x = _version_base(df, k, ds, q)
    d = F.weekday(ds) == F.weekday("_t")
    g = x.groupBy(*keys).agg(F.max("_t").alias("target_date"), F.avg(q).alias("_mean"),
                             F.count_if(d).alias("_nd"), F.avg(F.when(d, F.col(q))).alias("_md"),
                             F.avg(F.when(d & (F.col("_rdd") <= 3), F.col(q))).alias("_r3"),
                             F.avg(F.when(d & (F.col("_rnd") <= 3), F.col(q))).alias("_o3"))
    factor = F.when(F.col("_o3") > 0, F.col("_r3") / F.col("_o3")).otherwise(F.lit(1.0))
    fc = (F.when(F.col("_nd") >= 6, F.col("_r3") * _clip(factor, 0.7, 1.5))
           .when(F.col("_nd") >= 3, F.col("_md")).otherwise(F.col("_mean")))
    return g.select(*keys, "target_date", r6(fc).alias("forecast"))


def version_ses(df: DataFrame, k=None, ds: str = DS, q: str = Q, alpha: float = 0.3) -> DataFrame:
    """Simple exponential smoothing over the whole series, in closed form:
    s_n = (1-a)^(n-1) q_1 + sum_{i>=2} a (1-a)^(n-i) q_i -- one aggregate,
    no sequential loop."""
    keys = _k(k)
    x = _version_base(df, k, ds, q)
    n = F.col("_rn") + F.col("_rd") - 1
    w = F.when(F.col("_rn") == 1, F.pow(F.lit(1 - alpha), n - 1)) \
         .otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("_rd") - 1))
    g = x.groupBy(*keys).agg(F.max("_t").alias("target_date"), F.sum(w * F.col(q)).alias("_s"))
    return g.select(*keys, "target_date", r6("_s").alias("forecast"))


def version_seasonal(df: DataFrame, k=None, ds: str = DS, q: str = Q) -> DataFrame:
    """Mean of the last 7 x (target-month mean / overall mean) clipped 0.5..2."""
    keys = _k(k)
    x = _version_base(df, k, ds, q)
    m = F.month(ds) == F.month("_t")
    g = x.groupBy(*keys).agg(F.max("_t").alias("target_date"), F.avg(q).alias("_mean"),
                             F.avg(F.when(F.col("_rd") <= 7, F.col(q))).alias("_r7"),
                             F.avg(F.when(m, F.col(q))).alias("_mm"))
    fc = F.when(F.col("_mm").isNotNull() & (F.col("_mean") != 0),
                F.col("_r7") * _clip(F.col("_mm") / F.col("_mean"), 0.5, 2.0)).otherwise(F.col("_r7"))
    return g.select(*keys, "target_date", r6(fc).alias("forecast"))


def version_linear(df: DataFrame, k=None, ds: str = DS, q: str = Q, window: int = 14,
                   min_rows: int = 10) -> DataFrame:
    """Least squares over the last 14 points projected one step, floor 0
    (needs 10 rows; else the mean)."""
    keys = _k(k)
    x = _version_base(df, k, ds, q)
    n = F.col("_rn") + F.col("_rd") - 1
    m = F.least(n, F.lit(window))
    x = x.withColumn("_x", (m - F.col("_rd")).cast("double")).withColumn("_m", m)
    inw = F.col("_rd") <= window
    g = x.groupBy(*keys).agg(
        F.max("_t").alias("target_date"), F.avg(q).alias("_mean"), F.count(F.lit(1)).alias("_n"),
        F.max("_m").alias("_m"),
        F.regr_slope(F.when(inw, F.col(q)), F.when(inw, F.col("_x"))).alias("_b"),
        F.regr_intercept(F.when(inw, F.col(q)), F.when(inw, F.col("_x"))).alias("_a"))
    fc = F.when(F.col("_n") >= min_rows,
                F.greatest(F.col("_a") + F.col("_b") * F.col("_m"), F.lit(0.0))).otherwise(F.col("_mean"))
    return g.select(*keys, "target_date", r6(fc).alias("forecast"))


def version_weighted(df: DataFrame, k=None, ds: str = DS, q: str = Q, window: int = 10) -> DataFrame:
    """The last 10 values weighted 1 (oldest) .. 10 (newest)."""
    keys = _k(k)
    x = _version_base(df, k, ds, q)
    n = F.col("_rn") + F.col("_rd") - 1
    w = F.when(F.col("_rd") <= window, F.least(n, F.lit(window)) - F.col("_rd") + 1)
    g = x.groupBy(*keys).agg(F.max("_t").alias("target_date"),
                             (F.sum(w * F.col(q)) / F.sum(w)).alias("_w"))
    return g.select(*keys, "target_date", r6("_w").alias("forecast"))


# ------------------------------------------------------------------ backtest

def ma_backtest(df: DataFrame, k: Sequence[str] = ("forecast_version_name",), ds: str = "order_date",
                q: str = "total_demand_qty", window: int = 7, warmup: int = 3,
                min_rows: int = 5) -> DataFrame:
    """Per group, daily totals; one-step forecast = mean of the previous
    ``window`` daily totals, from the fourth day, positive forecasts only;
    groups with fewer than ``min_rows`` input rows are skipped."""
    keys = list(k)
    daily = df.groupBy(*keys, ds).agg(F.sum(q).alias("actual"), F.count(F.lit(1)).alias("_rows"))
    wk = W.partitionBy(*keys)
    w = wk.orderBy(ds)
    x = (daily.withColumn("_grp_rows", F.sum("_rows").over(wk))
              .withColumn("_idx", F.row_number().over(w) - 1)
              .withColumn("forecast", F.avg("actual").over(w.rowsBetween(-window, -1))))
    return (x.where((F.col("_grp_rows") >= min_rows) & (F.col("_idx") >= warmup)
                    & F.col("actual").isNotNull() & (F.col("forecast") > 0))
             .select(*keys, ds, "actual", "forecast"))


def best_version(bt: DataFrame, version: str = "forecast_version_name", ds: str = "order_date",
                 hist: DataFrame | None = None) -> DataFrame:
    """The version with the lowest MAPE, its grade, points, and coverage
    (% of the analysed days -- all days of ``hist`` -- it forecast)."""
    from .accuracy import error_summary
    from ..functions.columns import grade
    s = error_summary(bt, [version])
    days = (hist if hist is not None else bt).select(ds).distinct().agg(F.count(F.lit(1))).scalar()
    best = s.where(F.col("mape").isNotNull()).orderBy("mape", version).limit(1)
    return best.select(F.col(version).alias("best_version"), "mape", grade("mape").alias("grade"),
                       F.col("data_points"),
                       r6(F.col("data_points") * 100.0 / days).alias("coverage_pct"))


def forecast_vs_actual(hist: DataFrame, fc: DataFrame, ds: str = "order_date",
                       actual: str = "total_demand_qty", forecast: str = "forecast") -> DataFrame:
    """one timeline -- actual where history exists, forecast where the
    forecast exists (full outer join on the date)."""
    h = hist.select(ds, F.col(actual).alias("actual"))
    f = fc.select(ds, F.col(forecast).cast("double").alias("forecast"))
    return h.join(f, ds, "full_outer")
