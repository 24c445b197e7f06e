"""Planner adjustments.

The adjustment log is an append-only table (see ``sources.sinks.append_log``
and ``streaming``); these operators are joins and aggregates over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6, round_to
from ..session import cut_lineage
from . import forecast as fc
from . import profiles as pr


def apply_adjustments(adj: DataFrame, current: str = "current_value", kind: str = "adjustment_type",
                      value: str = "adjustment_value", supplied: str = "new_forecast_value") -> DataFrame:
    """Absolute -> value; percentage -> current x (1 + v/100); multiplier
    -> current x v (v itself when current is 0 in the last two); a supplied
    new value is what is stored; change and change %."""
    cur, v = F.col(current), F.col(value)
    expected = (F.when(F.col(kind) == "absolute", v)
                 .when(F.col(kind) == "percentage", F.when(cur != 0, cur * (1 + v / 100)).otherwise(v))
                 .when(F.col(kind) == "multiplier", F.when(cur != 0, cur * v).otherwise(v)))
    sup = F.col(supplied) if supplied in adj.columns else F.lit(None).cast("double")
    final = F.coalesce(sup, expected)
    x = adj.withColumn("new_value", final)
    return x.withColumns({
        "change": r6(F.col("new_value") - cur),
        "change_percentage": r6(F.when(cur != 0, (F.col("new_value") - cur) / cur * 100)),
        "new_value": r6("new_value"),
    })


#: Stands for "any" where an adjustment names no channel or location.
ANY = "*"


def adjustment_review(adj: DataFrame, hist: DataFrame, master: DataFrame, promo: DataFrame,
                      sku: str = "sku_id", ds: str = "ds", q: str = "order_qty",
                      high_rows: int = 50, places: Sequence[str] = ()) -> DataFrame:
    """Each adjustment with its validation (does the series it names have
    history), history context (F22), SKU info (D15), active promotion of the
    SKU's product on the target date (D12), the system forecast for that date
    (G06) and the differences; confidence 'high' above ``high_rows`` history
    rows.  ``places`` are further key columns of adjustments and history."""
    from .joins import promo_days
    from ..functions.columns import norm_text
    keys = [sku, *places]
    a = apply_adjustments(adj)
    stats = pr.history_stats(hist, keys, ds, q)
    targets = a.select(*keys, "target_date").distinct()
    sysf = fc.current_forecast(hist, keys, ds, q, targets=targets) \
             .select(*keys, "target_date", F.col("forecast").alias("system_forecast"))
    m = master.select(sku, "product_name", "brand").dropDuplicates([sku])
    pdays = promo_days(promo).select("_pk", "_day", F.col("_disc").alias("promo_discount"))
    x = (a.join(stats.select(*keys, "total_records", "avg_quantity"), keys, "left")
          .join(m, sku, "left")
          .join(sysf, [*keys, "target_date"], "left"))
    x = x.join(pdays, (norm_text("brand") == F.col("_pk")) & (F.col("target_date") == F.col("_day")), "left")
    sysv = F.col("system_forecast")
    return x.select(
        "adjustment_id", *keys, "target_date", "adjustment_type", "current_value", "new_value",
        F.col("total_records").isNotNull().alias("sku_has_history"),
        F.coalesce("total_records", F.lit(0)).alias("historical_data_points"), "avg_quantity",
        "product_name", "brand",
        F.col("_pk").isNotNull().alias("active_promotion"), "promo_discount",
        "system_forecast",
        r6(F.col("current_value") - sysv).alias("user_input_vs_system"),
        r6(F.col("new_value") - sysv).alias("adjustment_vs_system"),
        F.when(sysv.isNotNull(), F.when(F.coalesce("total_records", F.lit(0)) > high_rows, "high")
               .otherwise("medium")).alias("system_confidence"))


def series_asked_for(hist: DataFrame, asked: DataFrame, sku: str, places: Sequence[str], ds: str, q: str,
                     flag: str | None = None) -> DataFrame:
    """Daily sums of every series in ``asked``, whatever it leaves open (``ANY``).

    Rows of the SKUs asked for are summed by day at the finest grain, copied
    into the grains that name fewer places (a grouping set for each), cut to the
    series asked for, and summed again; nothing is computed or shuffled for a
    SKU that nobody named."""
    flags = [F.bool_or(flag).alias(flag)] if flag else []
    out = hist.join(asked.select(sku).distinct(), sku, "left_semi").groupBy(sku, *places, ds).agg(F.sum(q).alias(q), *flags)
    for p in places:
        out = out.withColumn(p, F.explode(F.array(F.lit(ANY), F.col(p).cast("string"))))
    out = out.join(asked.select(sku, *places).distinct(), [sku, *places], "left_semi")
    return out.groupBy(sku, *places, ds).agg(F.sum(q).alias(q), *flags)


def adjustment_review_by_place(adj: DataFrame, hist: DataFrame, master: DataFrame, promo: DataFrame, sku: str = "sku_id",
                               channel: str = "channel", location: str = "location", ds: str = "order_date",
                               q: str = "total_demand_qty", flag: str = "is_promotional", high_rows: int = 50) -> DataFrame:
    """J02 by SKU, channel and location: every adjustment is reviewed against
    the series it names -- an empty channel or location means all of them -- and
    gets ``warnings`` (B15's, of what it names) and ``recommendations`` (J05, for
    its target date), each joined by ``|``."""
    from . import quality
    places = [channel, location]
    given = lambda c: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")), F.lit(ANY))
    a = adj.withColumns({c: given(c) for c in places})
    asked = a.select(sku, *places, "target_date").distinct()
    # read by every part of the review: the named series' days are written once
    daily = cut_lineage(series_asked_for(hist, asked, sku, places, ds, q, flag))
    out = adjustment_review(a, daily, master, promo, sku, ds, q, high_rows, places)
    advice = adjustment_advice(daily, [sku, *places], ds, q, asked).select(sku, *places, "target_date", "recommendations")
    there = quality.distinct_values(hist.select(*[F.col(c).cast("string").alias(c) for c in (sku, *places)]), [sku, *places])
    known = [there[c].withColumn(f"_has_{c}", F.lit(True)) for c in (sku, *places)]
    listed = master.select(sku).distinct().withColumn("_listed", F.lit(True))
    for k, c in zip(known, (sku, *places)):
        out = out.join(k, c, "left")
    out = out.join(listed, sku, "left").join(advice, [sku, *places, "target_date"], "left")
    named = lambda c: F.when(F.col(c) == ANY, "").otherwise(F.col(c))
    lost = lambda c: F.col(f"_has_{c}").isNull() & (named(c) != "")
    return (out.withColumn("warnings", F.array_join(quality.combination_warnings(
                F.col(sku), named(channel), named(location), lost(sku), lost(channel), lost(location),
                ~F.col("sku_has_history"), F.col("_listed").isNull()), "|"))
               .drop("_listed", *[f"_has_{c}" for c in (sku, *places)]))


def adjustment_history(log: DataFrame, filters: Mapping[str, str] | None = None, days: int = 30,
                       n: int = 50, as_of=None, ts: str = "created_at") -> DataFrame:
    """The log filtered by sku / channel / location and age (relative to
    ``as_of``, default the newest entry), newest first, at most n rows."""
    x = log
    for c, v in (filters or {}).items():
        if v is not None and c in x.columns:
            x = x.where(F.col(c) == F.lit(v))
    ref = F.lit(as_of).cast("timestamp") if as_of is not None else log.agg(F.max(ts)).scalar()
    x = x.where(F.col(ts) >= ref - F.make_interval(days=F.lit(days)))
    return x.orderBy(F.desc(ts), F.desc("adjustment_id")).limit(n)


def adjustment_summary(log: DataFrame, reason: str = "reason_category") -> DataFrame:
    """Total, mean change, ups, downs, most common reason (ties: smallest)."""
    a = apply_adjustments(log)
    ch = F.col("new_value") - F.col("current_value")
    counts = a.groupBy(reason).count()
    top = counts.agg(F.min_by(reason, F.struct(-F.col("count"), F.col(reason))).alias("r")).select("r").scalar()
    return a.agg(F.count(F.lit(1)).alias("total_adjustments"), r6(F.avg(ch)).alias("avg_change"),
                 F.count_if(ch > 0).alias("positive_adjustments"),
                 F.count_if(ch < 0).alias("negative_adjustments")) \
            .withColumn("most_common_reason", top)


def adjustment_advice(df: DataFrame, k: Sequence[str] = ("customer_id", "product_id"), ds: str = "ds",
                      q: str = "order_qty", targets: DataFrame | None = None) -> DataFrame:
    """Per series and requested ``target_date`` (rows of ``targets``; by
    default the day after the series' last date): strong trend (F23
    magnitude > 20 %), weekday mean more than 15 % off the overall mean (at
    least 3 rows), promotional lift above 20 % (F21)."""
    keys = list(k)
    hs = pr.history_stats(df, keys, ds, q).select(*keys, "avg_quantity", "end_date")
    rv = pr.recent_vs_old(df, keys, ds, q).select(*keys, "trend_direction", "trend_magnitude")
    pp = pr.promo_profile(df, keys, q).select(*keys, "promotional_lift")
    dw = pr.dow_profile(df, keys, ds, q).select(*keys, "day_of_week", F.col("mean").alias("dow_avg"),
                                                F.col("count").alias("dow_n"))
    if targets is None:
        x = hs.withColumn("day_of_week", F.weekday(F.date_add("end_date", 1)))
    else:
        asked = targets.select(*keys, "target_date").distinct()
        x = hs.join(asked, keys).withColumn("day_of_week", F.weekday("target_date"))
    x = (x.join(dw, keys + ["day_of_week"], "left").join(rv, keys, "left").join(pp, keys, "left"))
    trend = F.coalesce(F.col("trend_magnitude"), F.lit(0.0)) > 20
    ovr = F.col("avg_quantity")
    dow_flag = (F.coalesce("dow_n", F.lit(0)) >= 3) & (ovr > 0) & (F.abs(F.col("dow_avg") - ovr) / ovr > 0.15)
    lift = F.coalesce(F.col("promotional_lift"), F.lit(0.0)) > 20

    def f1(c):
        return round_to(c, 1).cast("string")
    msgs = F.concat_ws(" | ",
                       F.when(trend, F.concat(F.lit("Strong "), F.col("trend_direction"), F.lit(" trend detected ("),
                                              f1("trend_magnitude"), F.lit("% change)"))),
                       F.when(dow_flag, F.concat(F.lit("Day-of-week pattern: "), f1("dow_avg"),
                                                 F.lit(" vs overall avg "), f1(ovr))),
                       F.when(lift, F.concat(F.lit("Historical promotional lift: "), f1("promotional_lift"),
                                             F.lit("%"))))
    return x.select(*keys, *(["target_date"] if targets is not None else []), trend.alias("trend_flag"), dow_flag.alias("dow_flag"), lift.alias("lift_flag"),
                    msgs.alias("recommendations"))
