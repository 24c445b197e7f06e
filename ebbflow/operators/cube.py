"""Roll-up / drill-down cube over the demand history.

The product-location-channel hierarchy has seven fixed levels.  Every
operator is a filter (pushed into the scan by Catalyst) followed by one
``groupBy`` with map-side partial aggregation, so a hot key costs one partial
row per task, not a skewed shuffle.  ``rollup_all`` computes all levels from
one scan and one shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import r6

DS = "order_date"

# The hierarchy levels and their dimensions (date implied).
LEVELS: dict[str, list[str]] = {
    "national_day": [],
    "brand_day": ["brand"],
    "brand_location_day": ["brand", "location"],
    "brand_channel_day": ["brand", "channel"],
    "sku_day": ["sku_id"],
    "sku_location_day": ["sku_id", "location"],
    "sku_channel_day": ["sku_id", "channel"],
}
PARENTS = {
    "sku_location_day": ["sku_day"], "sku_channel_day": ["sku_day"],
    "sku_day": ["brand_day"], "brand_day": ["national_day"],
    "brand_location_day": ["brand_day"], "brand_channel_day": ["brand_day"],
    "national_day": [],
}
CHILDREN = {
    "sku_location_day": [], "sku_channel_day": [],
    "sku_day": ["sku_location_day", "sku_channel_day"],
    "brand_day": ["sku_day", "brand_location_day", "brand_channel_day"],
    "brand_location_day": ["sku_location_day"],
    "brand_channel_day": ["sku_channel_day"],
    "national_day": ["brand_day"],
}
ALL_DIMS = ["brand", "sku_id", "location", "channel"]
# Metric classes of the metric policy (F09); revenue is summed too.
ADDITIVE = ["total_demand_qty", "base_demand_qty", "promotional_demand_qty",
            "current_inventory_units", "warehouse_inventory_qty",
            "customer_inventory_qty", "in_transit_qty", "revenue"]
WEIGHTED_AVG = ["discount_percent", "expected_lift_factor", "seasonality_index",
                "demand_volatility", "competitor_activity_score"]
SIMPLE_AVG = ["historical_avg_demand_7d", "historical_avg_demand_30d",
              "prediction_interval_lower", "prediction_interval_upper",
              "forecast_confidence", "economic_indicator", "consumer_confidence"]
MAX_LATEST = ["is_promotional", "manual_adjustment_flag", "is_frozen",
              "is_approved_version", "lifecycle_stage", "abc_classification"]
FILTER_DIMS = ["sku_id", "brand", "category", "location", "channel", "customer"]


def _sum_double(c: str) -> Column:
    return F.sum(c).cast("double").alias(c)


def additive_aggs(df: DataFrame) -> list[Column]:
    aggs = [_sum_double(c) for c in ADDITIVE if c in df.columns]
    return aggs + [F.count(F.lit(1)).alias("record_count")]


def apply_filters(df: DataFrame, filters: Mapping | None = None, start=None, end=None,
                  include_promotional: bool = True, ds: str = DS) -> DataFrame:
    """F10 filters: equality on dimensions, date range, promo exclusion."""
    cond = F.lit(True)
    for k, v in (filters or {}).items():
        if v is not None and k in df.columns:
            cond = cond & (F.col(k) == F.lit(v))
    if start is not None:
        cond = cond & (F.col(ds) >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (F.col(ds) <= F.lit(end).cast("date"))
    if not include_promotional and "is_promotional" in df.columns:
        cond = cond & ~F.col("is_promotional")
    return df.where(cond)


def rollup(df: DataFrame, level: str, filters: Mapping | None = None, start=None, end=None,
           include_promotional: bool = True, ds: str = DS) -> DataFrame:
    """Sums of the additive metrics and a row count per level key."""
    dims = LEVELS[level] + [ds]
    df = apply_filters(df, filters, start, end, include_promotional, ds)
    return df.groupBy(*dims).agg(*additive_aggs(df))


def rollup_policy(df: DataFrame, level: str, weight: str = "total_demand_qty",
                  ds: str = DS) -> DataFrame:
    """each metric aggregated by its declared class."""
    dims = LEVELS[level] + [ds]
    aggs = additive_aggs(df)
    w = F.col(weight)
    for c in WEIGHTED_AVG:
        if c in df.columns:
            aggs.append((F.sum(F.col(c) * w) / F.sum(w)).alias(c))
    for c in SIMPLE_AVG:
        if c in df.columns:
            aggs.append(F.avg(c).alias(c))
    for c in MAX_LATEST:
        if c in df.columns:
            aggs.append(F.max(c).alias(c))
    return df.groupBy(*dims).agg(*aggs)


def rollup_all(df: DataFrame, ds: str = DS) -> DataFrame:
    """all seven levels, labelled by level.

    Rows are shuffled once, by SKU, and summed to (brand, SKU, location,
    channel, day) -- decimals stay decimals.  Every level reads that one
    shuffle.  The levels of a SKU, which have nearly as many rows, are summed
    where those sums lie; only the coarser ones, bounded by brands, places and
    days, are shuffled again."""
    cols = ALL_DIMS + [ds]
    there = [c for c in ADDITIVE if c in df.columns]
    # as many parts as the session shuffles into, none merged: a task holds the sums of its part four times
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fine = (df.select(*cols, *there).repartition(n, "sku_id").groupBy(*cols)
              .agg(*[F.sum(c).alias(c) for c in there], F.count(F.lit(1)).alias("record_count")))
    sums = [*[_sum_double(c) for c in there], F.sum("record_count").alias("record_count")]
    out = [*cols, *there, "record_count", "level"]

    def filled(x):
        return x.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cols if c not in x.columns}).select(*out)

    of_sku = [filled(fine.groupBy(*dims, ds).agg(*sums, F.lit(lv).alias("level"))) for lv, dims in LEVELS.items() if "sku_id" in dims]
    coarse = {lv: dims for lv, dims in LEVELS.items() if "sku_id" not in dims}
    rest = [c for c in cols if c != "sku_id"]
    gid = F.grouping_id(*rest)
    label = F.lit(None).cast("string")
    for lv, dims in coarse.items():
        bits = sum(1 << (len(rest) - 1 - i) for i, c in enumerate(rest) if c not in [*dims, ds])
        label = F.when(gid == bits, F.lit(lv)).otherwise(label)
    high = fine.groupingSets([[*dims, ds] for dims in coarse.values()], *rest).agg(*sums, label.alias("level"))
    return reduce(DataFrame.unionAll, [filled(high), *of_sku])


def rollup_summary(agg: DataFrame, qty: str = "total_demand_qty", ds: str = DS,
                   top_n: int = 5) -> DataFrame:
    """one-row summary of a roll-up result; top locations by frequency."""
    base = agg.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(ds).alias("start_date"), F.max(ds).alias("end_date"),
        F.date_diff(F.max(ds), F.min(ds)).alias("total_days"),
        F.sum(qty).cast("long").alias("total_demand"),
        F.bround(F.avg(qty), 0).alias("average_daily_demand"),
        F.stddev_samp(qty).alias("demand_volatility"),
        F.min(qty).cast("long").alias("min_demand"),
        F.max(qty).cast("long").alias("max_demand"),
        F.sum("promotional_demand_qty").cast("long").alias("total_promotional_demand"),
        (F.sum("promotional_demand_qty") * 100
         / (F.sum("promotional_demand_qty") + F.sum("base_demand_qty")))
        .alias("promotional_percentage"),
        F.count_distinct("location").alias("unique_locations"))
    top = value_counts(agg, "location", top_n)
    tops = top.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "location", "count"))),
        lambda s: F.concat(s["location"], F.lit(":"), s["count"].cast("string"))), ",")
        .alias("top_locations"))
    return (base.withColumn("demand_volatility", r6("demand_volatility"))
                .withColumn("promotional_percentage", r6("promotional_percentage"))
                .withColumn("top_locations", tops.scalar()))


def value_counts(df: DataFrame, col: str, n: int = 100, filters: Mapping | None = None) -> DataFrame:
    """the n most frequent non-null values with counts (ties by value).

    Top-k is the feature here.  ``orderBy().limit()`` plans as TakeOrdered:
    every task keeps its best n, so no task ever holds all distinct values.
    """
    df = apply_filters(df, filters)
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), F.asc(col)).limit(n)
    # at most n rows remain; ranking them in one task is bounded by n
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("count"), F.asc(col))))


def option_search(df: DataFrame, col: str, q: str, n: int = 20) -> DataFrame:
    """F16: most frequent values containing ``q`` (case-insensitive)."""
    hit = df.where(F.lower(F.col(col)).contains(q.lower()))
    return value_counts(hit, col, n)


def _nonblank(c: str) -> Column:
    x = F.trim(F.col(c).cast("string"))
    return x.isNotNull() & (x != "") & (F.lower(x) != "nan") & (F.lower(x) != "none")


def dimension_values(df: DataFrame, dim: str, n: int = 50, filters: Mapping | None = None) -> DataFrame:
    """up to n sorted distinct non-blank values of a dimension."""
    df = apply_filters(df, filters)
    vals = df.where(_nonblank(dim)).select(F.col(dim).cast("string").alias("value")).distinct()
    return vals.orderBy("value").limit(n)


def drill_down(df: DataFrame, from_level: str, to_level: str, filters: Mapping | None = None,
               n: int = 50, ds: str = DS) -> DataFrame:
    """roll-up at the child level for each of the first n values of the
    dimension the drill step adds -- one grouped query, not one per value."""
    added = [d for d in LEVELS[to_level] if d not in LEVELS[from_level]]
    dim = added[0] if added else LEVELS[to_level][0]
    vals = dimension_values(df, dim, n, filters).withColumnRenamed("value", dim)
    base = apply_filters(df, filters)
    # ``vals`` holds at most n rows by construction: broadcast is size-bounded
    kept = base.join(F.broadcast(vals), dim, "left_semi")
    return kept.groupBy(*(LEVELS[to_level] + [ds])).agg(*additive_aggs(base))


def drill_steps(level: str) -> list[tuple[str, str, str]]:
    """(direction, target level, dimension added or removed) for a level."""
    out = []
    for direction, targets in (("down", CHILDREN[level]), ("up", PARENTS[level])):
        for t in targets:
            a, b = (t, level) if direction == "down" else (level, t)
            step = [d for d in LEVELS[a] if d not in LEVELS[b]]
            out.append((direction, t, step[0]))
    return out


def drill_options(df: DataFrame, level: str, samples: int = 3, ds: str = DS) -> DataFrame:
    """valid child and parent levels with the distinct count of the
    dimension each step adds or removes, the first sample values of it and
    the number of rows the target level has.

    One scan: the rows are first cut to distinct combinations of all columns
    involved, and only these are copied, one (what is counted, its value) row
    each; distinct ones of those give every count and the samples."""
    steps = drill_steps(level)
    counted = {d: [d] for _, _, d in steps} | {f"rows of {t}": LEVELS[t] + [ds] for _, t, _ in steps}
    fine = df.select(*sorted({c for cols in counted.values() for c in cols})).distinct()
    text = lambda c: F.col(c).cast("string")
    known = lambda cols: reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cols])
    copies = F.array_compact(F.array(*[F.when(known(cols), F.struct(F.lit(name).alias("what"), F.array(*map(text, cols)).alias("value")))
                                       for name, cols in counted.items()]))
    values = fine.select(F.explode(copies).alias("_v")).select("_v.what", "_v.value").distinct()
    counts = values.groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    dims = [d for _, _, d in steps]
    first = (values.where(F.col("what").isin(dims)).withColumn("value", F.col("value")[0])
             .withColumn("_rn", F.row_number().over(W.partitionBy("what").orderBy("value"))).where(F.col("_rn") <= samples)
             .groupBy(F.col("what").alias("dimension")).agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("sample_values")))
    opts = F.array(*[F.struct(F.lit(x).alias("direction"), F.lit(t).alias("target_level"), F.lit(d).alias("dimension")) for x, t, d in steps])
    found = counts.agg(F.map_from_entries(F.collect_list(F.struct("what", "n"))).alias("_n"))       # one entry a step
    number = lambda c: F.coalesce(F.element_at("_n", c), F.lit(0).cast("long"))
    out = found.select("_n", F.explode(opts).alias("o")).select(
        "o.direction", "o.target_level", "o.dimension", number(F.col("o.dimension")).alias("distinct_values"),
        number(F.concat(F.lit("rows of "), F.col("o.target_level"))).alias("row_estimate"))
    return out.join(first, "dimension", "left")


def distinct_sketches(df: DataFrame, cell: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per cell a mergeable sketch of each column's distinct values: cells of a
    coarser level are had by merging, without another scan."""
    return df.groupBy(*cell).agg(*[F.hll_sketch_agg(F.col(c).cast("string")).alias(c) for c in cols])


def merged_distinct(sketches: DataFrame, cell: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Distinct values (estimated, about 1.6 % off) of the cells that
    ``sketches`` add up to."""
    return sketches.groupBy(*cell).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in cols])


def data_summary(df: DataFrame, ds: str = DS) -> DataFrame:
    """rows, date range, distinct SKUs / channels / locations / combos, promo share."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(ds).alias("start_date"), F.max(ds).alias("end_date"),
        F.count_distinct("sku_id").alias("unique_skus"),
        F.count_distinct("channel").alias("unique_channels"),
        F.count_distinct("location").alias("unique_locations"),
        F.count_distinct("sku_id", "channel", "location").alias("unique_combinations"),
        F.count_if("is_promotional").alias("promotional_records"),
        (F.count_if("is_promotional") * 100.0 / F.count(F.lit(1))).alias("promotional_percentage"))


def rollup_quality(agg: DataFrame, ds: str = DS) -> DataFrame:
    """Completeness (share of columns without nulls), temporal coverage
    min(100, rows/days*100), their mean, and a Good/Fair/Poor label."""
    cols = agg.columns
    nulls = agg.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
                    F.count(F.lit(1)).alias("__rows"),
                    F.date_diff(F.max(ds), F.min(ds)).alias("__days"))
    complete = sum((F.col(c) == 0).cast("int") for c in cols)
    comp = complete * 100.0 / len(cols)
    days = F.col("__days")
    cov = F.when(days > 0, F.least(F.col("__rows") * 100.0 / days, F.lit(100.0))).otherwise(100.0)
    return nulls.select(
        comp.alias("completeness_score"), cov.alias("coverage_score"),
        (days - F.col("__rows")).alias("date_gaps"),
        ((comp + cov) / 2).alias("overall_score"),
        F.when(cov > 80, "Good").when(cov > 60, "Fair").otherwise("Poor").alias("continuity"))
