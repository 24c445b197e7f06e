"""Validation, profiling and data-quality checks.

Each check is one aggregate pass (map-side partial aggregation) or a
predicate; results are small DataFrames, never driver-side loops over rows.
Scalar thresholds computed from data enter later stages as scalar
subqueries (evaluated once, no join).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.columns import MISSING_TOKENS, parse_timestamp, r6
from ..session import cut_lineage
from . import clean

# Name fragments used to classify columns.
METRIC_HINTS_STRUCTURE = ("qty", "amount", "price", "total", "count")
DATE_HINTS_STRUCTURE = ("date", "time")
METRIC_HINTS_FILTER = ("qty", "quantity", "amount", "price", "cost", "value", "total", "sum",
                       "count", "avg", "mean", "std", "min", "max", "percent", "rate", "ratio",
                       "index", "score", "weight", "volume", "units")
DATE_HINTS_FILTER = ("date", "time", "timestamp", "day", "month", "year")


def structure_check(df: DataFrame, essential: Sequence[str], max_missing: float = 0.5) -> DataFrame:
    """Missing essential columns and their ratio, duplicate names, rows."""
    missing = [c for c in essential if c not in df.columns]
    seen, dup = set(), []
    for c in df.columns:
        if c.lower() in seen and c not in dup:
            dup.append(c)
        seen.add(c.lower())
    ratio = len(missing) / len(essential) if essential else 0.0
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(df.columns)).alias("total_columns"),
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_essential"),
        F.lit(ratio).alias("missing_ratio"),
        F.array(*[F.lit(c) for c in dup]).cast("array<string>").alias("duplicate_columns"),
        ((F.lit(ratio) <= max_missing) & (F.col("total_rows") > 0)).alias("validation_passed"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``d``, the rows that repeat an earlier one.  Whole rows are
    grouped, in one pass over ``df``."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("d"))


def table_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column type, null count and distinct count; table rows and
    duplicate rows.

    Columns are stacked as (column, value) and counted per value, so all
    distinct counts are one grouped aggregate with partial sums;
    ``approx=True`` uses HyperLogLog++ sketches instead.  Every column's counts
    add up to the rows of the table, so ``df`` is read twice: for its values
    and for its repeated rows."""
    cols = df.columns
    if approx:
        g = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (F.count_if(F.col(c).isNull()).alias(f"n{i}"),
                                                             F.approx_count_distinct(c).alias(f"u{i}"))])
        per = g.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"n{i}").alias("n_null"), F.col(f"u{i}").alias("n_unique"), F.col("n").alias("total_rows"))
                                           for i in range(len(cols))])).alias("r")).select("r.*")
    else:
        stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("string").alias("_v"))
                                                for i, c in enumerate(cols)])).alias("s")).select("s._i", "s._v")
        per = (stacked.groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("_c")).groupBy("_i")
               .agg(F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("n_null"), F.count("_v").alias("n_unique"),
                    F.sum("_c").alias("total_rows")))
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_i") + 1)
    return clean.beside(per, duplicate_rows(df)).select(
        at(cols).alias("column_name"), at([df.schema[c].dataType.simpleString() for c in cols]).alias("data_type"),
        "n_null", "n_unique", "total_rows", F.col("d").alias("duplicate_rows"))


def type_check(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Expected vs actual type per column ('float' accepts integers)."""
    accept = {
        "float": {"double", "float", "int", "bigint", "smallint", "tinyint"},
        "int": {"int", "bigint", "smallint", "tinyint"},
        "datetime": {"timestamp", "timestamp_ntz", "date"},
        "string": {"string"},
    }
    spark = df.sparkSession
    rows = []
    for c, typ in schema.items():
        if c in df.columns:
            actual = df.schema[c].dataType.simpleString()
            ok = actual in accept.get(typ, {typ}) or actual.startswith("decimal") and typ == "float"
            rows.append((c, typ, actual, bool(ok)))
    sch = "column_name string, expected string, actual string, ok boolean"
    return spark.createDataFrame(rows, sch)


def required_nulls(df: DataFrame, cols: Sequence[str], tol: float = 0.1) -> DataFrame:
    """Null count and rate of required columns; flag above ``tol``."""
    g = df.agg(F.count(F.lit(1)).alias("_n"),
               *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count"))
                     for c in cols])
    x = g.select("_n", F.explode(rows).alias("r")).select("_n", "r.*")
    rate = F.col("null_count") / F.col("_n")
    return x.select("column_name", "null_count", r6(rate).alias("null_rate"),
                    (rate > tol).alias("high_null"))


def schema_drift(old: DataFrame, new: DataFrame, expected: Sequence[str] | None = None) -> DataFrame:
    """Added / removed / changed columns between two schemas (full outer
    join of two small schema tables), plus columns outside ``expected``."""
    spark = new.sparkSession
    a = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in old.schema.fields],
                              "column_name string, old_type string")
    b = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in new.schema.fields],
                              "column_name string, new_type string")
    j = a.join(b, "column_name", "full_outer")
    change = (F.when(F.col("old_type").isNull(), "added")
               .when(F.col("new_type").isNull(), "removed")
               .when(F.col("old_type") != F.col("new_type"), "changed"))
    out = j.withColumn("change", change)
    if expected is not None:
        out = out.withColumn("unexpected", ~F.col("column_name").isin(list(expected))
                             & F.col("new_type").isNotNull())
    return out.where(F.col("change").isNotNull() | (F.col("unexpected") if expected else F.lit(False)))


def _fenced(df: DataFrame, col: str, m: float) -> DataFrame:
    """``df`` with the fences of ``col`` as ``_low`` and ``_high``."""
    q1, q3 = F.col(col)[0], F.col(col)[1]
    fences = clean.quantiles(df, [col], [0.25, 0.75]).select(
        (q1 - m * (q3 - q1)).alias("_low"), (q3 + m * (q3 - q1)).alias("_high"))
    return clean.beside(df, fences)


def iqr_outliers(df: DataFrame, col: str, m: float = 1.5) -> DataFrame:
    """Rows outside [q1 - m*iqr, q3 + m*iqr] (linear quantiles)."""
    return _fenced(df, col, m).where((F.col(col) < F.col("_low")) | (F.col(col) > F.col("_high"))).drop("_low", "_high")


def iqr_remove(df: DataFrame, col: str, m: float = 1.5) -> DataFrame:
    """Rows inside the fences (null values dropped)."""
    return _fenced(df, col, m).where((F.col(col) >= F.col("_low")) & (F.col(col) <= F.col("_high"))).drop("_low", "_high")


def iqr_summary(df: DataFrame, cols: Sequence[str], m: float = 1.5) -> DataFrame:
    """Outlier count per column: one pass for all quantiles, one pass
    for all counts."""
    limits = []
    for c in cols:
        q1, q3 = F.col(c)[0], F.col(c)[1]
        limits += [(q1 - m * (q3 - q1)).alias(f"_low_{c}"), (q3 + m * (q3 - q1)).alias(f"_high_{c}")]
    fenced = clean.beside(df.select(*cols), clean.quantiles(df, list(cols), [0.25, 0.75]).select(*limits))
    counts = [F.count_if((F.col(c) < F.col(f"_low_{c}")) | (F.col(c) > F.col(f"_high_{c}"))).alias(c) for c in cols]
    g = fenced.agg(*counts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_outliers"))
                     for c in cols])
    return g.select(F.explode(rows).alias("r")).select("r.*")


def _present(c: str, allow_zero: bool = False) -> Column:
    x = F.lower(F.trim(F.col(c).cast("string")))
    bad = [t for t in MISSING_TOKENS if allow_zero is False or t != "0"]
    return F.col(c).isNotNull() & ~x.isin(*bad)


def valid_transactions(df: DataFrame, order_id: str = "order_id", product_id: str = "sku_id",
                       ds: str = "order_date", qty: str = "order_qty", city: str = "city") -> DataFrame:
    """Ids, date, non-zero quantity and city present and not missing-like."""
    q = F.col(qty)
    return df.where(_present(order_id) & _present(product_id) & F.col(ds).isNotNull()
                    & q.isNotNull() & (q != 0) & _present(city, allow_zero=True))


def date_parse_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of values that parse as a timestamp (ISO or one of the other
    known forms); fail < 50 %, warn < 80 %."""
    aggs = [F.avg(parse_timestamp(F.col(c).cast("string")).isNotNull().cast("double")).alias(c)
            for c in cols]
    g = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rate")) for c in cols])
    x = g.select(F.explode(rows).alias("r")).select("r.*")
    return x.select("column_name", r6("rate").alias("parse_rate"),
                    F.when(F.col("rate") < 0.5, "fail").when(F.col("rate") < 0.8, "warn")
                     .otherwise("ok").alias("status"))


def duplicate_key_rate(df: DataFrame, keys: Sequence[str], limit: float = 0.15) -> DataFrame:
    """Share of rows repeating an earlier key (nulls compare equal)."""
    g = df.groupBy(*keys).count().agg(F.sum("count").alias("n"),
                                      F.sum(F.col("count") - 1).alias("dups"))
    rate = F.col("dups") / F.col("n")
    return g.select(F.col("dups").alias("duplicate_count"), r6(rate).alias("duplicate_rate"),
                    (rate < limit).alias("passed"))


def total_drift(before: DataFrame, after: DataFrame, col: str, limit: float = 0.05) -> DataFrame:
    """Relative change of a column total after cleaning; each side is read once."""
    one = clean.beside(before.agg(F.sum(col).alias("total_before")), after.agg(F.sum(col).alias("total_after")))
    b, a = F.col("total_before"), F.col("total_after")
    delta = F.when(b != 0, F.abs(b - a) / F.abs(b)).otherwise(F.lit(0.0))
    return one.select(b, a, r6(delta).alias("delta"), (delta < limit).alias("passed"))


def date_gaps(df: DataFrame, k: Sequence[str], ds: str, limit: float = 0.2) -> DataFrame:
    """Calendar days missing between the first and last date of each key,
    and their share of the span (arithmetic on distinct days: no calendar
    is materialised)."""
    g = df.groupBy(*k).agg(F.min(ds).alias("first"), F.max(ds).alias("last"),
                           F.count_distinct(ds).alias("days_present"))
    span = F.date_diff("last", "first") + 1
    missing = span - F.col("days_present")
    return g.select(*k, "first", "last", span.alias("span_days"), missing.alias("days_missing"),
                    r6(missing / span).alias("missing_rate"), (missing / span < limit).alias("passed"))


def missing_dates(df: DataFrame, k: Sequence[str], ds: str) -> DataFrame:
    """B13 detail: the missing calendar days themselves."""
    g = df.groupBy(*k).agg(F.min(ds).alias("_a"), F.max(ds).alias("_b"))
    cal = g.select(*k, F.explode(F.sequence("_a", "_b")).alias(ds))
    return cal.join(df.select(*k, ds).distinct(), list(k) + [ds], "left_anti")


def key_overlap(a: DataFrame, b: DataFrame, k: Sequence[str], a_ds: str, b_ds: str) -> DataFrame:
    """Distinct keys on each side, size of the intersection, date ranges."""
    ka = a.select(*k).distinct()
    kb = b.select(*k).distinct()
    inter = ka.intersect(kb).agg(F.count(F.lit(1))).scalar()
    sa = a.agg(F.min(a_ds).alias("a"), F.max(a_ds).alias("b"))
    sb = b.agg(F.min(b_ds).alias("a"), F.max(b_ds).alias("b"))
    return ka.agg(F.count(F.lit(1)).alias("left_keys")).select(
        "left_keys", kb.agg(F.count(F.lit(1))).scalar().alias("right_keys"),
        inter.alias("common_keys"),
        sa.select("a").scalar().alias("left_start"), sa.select("b").scalar().alias("left_end"),
        sb.select("a").scalar().alias("right_start"), sb.select("b").scalar().alias("right_end"))


def containing_pairs(asked: DataFrame, ids: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (a, b) where one string contains the other, without case,
    and they differ.

    An id that contains the request has all its grams of up to three letters:
    requests probe the ids' grams by the one that the fewest ids have.  An id
    within the request is one of its substrings: these are joined on equality.
    So ids of one template are met only by what tells them apart."""
    def grams(c, n):
        low, last = F.lower(c), F.length(c) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))) \
                .otherwise(F.array().cast("array<string>"))

    asked, ids = asked.select(a).where(F.length(a) > 0).distinct(), ids.select(b).where(F.length(b) > 0).distinct()
    width = F.least(F.length(a), F.lit(3))
    own = F.when(width == 1, grams(a, 1)).when(width == 2, grams(a, 2)).otherwise(grams(a, 3))
    postings = ids.select(b, F.explode(F.array_distinct(F.concat(*[grams(b, n) for n in (1, 2, 3)]))).alias("_g"))
    wanted = asked.select(a, F.explode(F.array_distinct(own)).alias("_g"))
    counts = postings.join(wanted.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (wanted.join(counts, "_g", "left").groupBy(a)
              .agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_g")))
    within = rarest.join(postings, "_g").where(F.lower(b).contains(F.lower(a))).select(a, b)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.transform(
        F.sequence(F.lit(1), F.length(a) - i + 1), lambda n: F.substr(F.lower(a), i, n))))
    inside = (asked.select(a, F.explode(F.array_distinct(parts)).alias("_g"))
              .join(ids.withColumn("_g", F.lower(b)), "_g").select(a, b))
    return within.unionAll(inside).where(F.col(a) != F.col(b)).distinct()


def _first_similar(asked: DataFrame, ids: DataFrame, a: str, b: str, n: int, name: str) -> DataFrame:
    """The first n ids that contain or are contained in each request, joined by ``|``."""
    x = containing_pairs(asked, ids, a, b)
    x = x.withColumn("_rn", F.row_number().over(W.partitionBy(a).orderBy(b))).where(F.col("_rn") <= n)
    return x.groupBy(a).agg(F.array_join(F.array_sort(F.collect_list(b)), "|").alias(name))


def combination_warnings(sku: Column, channel: Column, location: Column, no_sku: Column, no_channel: Column, no_location: Column,
                         no_combination: Column, not_listed: Column) -> Column:
    """Array of the warnings that hold for a (SKU, channel, location)."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])
    # The texts.
    return F.array_compact(F.array(
        F.when(no_sku, text("SKU ", sku, " not found in historical data")),
        F.when(no_location, text("Location ", location, " not found in historical data")),
        F.when(no_channel, text("Channel ", channel, " not found in historical data")),
        F.when(no_combination, text("No historical data for exact combination: SKU=", sku, ", Channel=", channel, ", Location=", location)),
        F.when(not_listed, text("SKU ", sku, " not found in master catalog"))))


def distinct_values(df: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """The distinct values of each column (null among them), all from one pass
    over ``df``, written once: as many rows as there are values."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).alias("_v")) for i, c in enumerate(cols)])).alias("s"))
    values = cut_lineage(stacked.select("s._i", "s._v").distinct())
    return {c: values.where(F.col("_i") == i).select(F.col("_v").alias(c)) for i, c in enumerate(cols)}


def validate_combinations(requests: DataFrame, hist: DataFrame, master: DataFrame,
                          sku: str = "sku_id", channel: str = "channel", location: str = "location",
                          ds: str = "order_date", qty: str = "total_demand_qty",
                          n_similar: int = 3) -> DataFrame:
    """For requested (sku, channel, location): existence of each value and
    of the combination, its rows, dates and mean, up to three similar SKUs and
    locations (that contain the request or are contained in it) where the value
    is unknown, the channels there are where the channel is unknown, whether the
    master catalogue has the SKU, and the warnings that follow (joined by ``|``).

    Requests of any number are joined on equal keys (AQE broadcasts them if
    they are few).  The values there are come from one pass over the history,
    and only rows of a requested combination are grouped."""
    req = requests.select(F.col(sku).alias("r_sku"), F.col(channel).alias("r_channel"),
                          F.col(location).alias("r_location"))
    there = distinct_values(hist, [sku, channel, location])
    skus, chans, locs = [there[c].withColumnRenamed(c, n) for c, n in ((sku, "_s"), (channel, "_c"), (location, "_l"))]
    named = hist.withColumns({"r_sku": F.col(sku), "r_channel": F.col(channel), "r_location": F.col(location)}) \
                .join(req.distinct(), ["r_sku", "r_channel", "r_location"], "left_semi")
    combo = named.groupBy("r_sku", "r_channel", "r_location").agg(
        F.count(F.lit(1)).alias("combination_rows"), F.min(ds).alias("first_date"),
        F.max(ds).alias("last_date"), r6(F.avg(qty)).alias("mean_qty"))
    out = (req.join(skus, F.col("r_sku") == F.col("_s"), "left")
             .join(chans, F.col("r_channel") == F.col("_c"), "left")
             .join(locs, F.col("r_location") == F.col("_l"), "left")
             .select("r_sku", "r_channel", "r_location",
                     F.col("_s").isNotNull().alias("sku_exists"),
                     F.col("_c").isNotNull().alias("channel_exists"),
                     F.col("_l").isNotNull().alias("location_exists")))
    out = out.join(combo, ["r_sku", "r_channel", "r_location"], "left") \
             .withColumn("combination_exists", F.col("combination_rows").isNotNull()) \
             .withColumn("combination_rows", F.coalesce("combination_rows", F.lit(0)))
    sim = _first_similar(req, skus, "r_sku", "_s", n_similar, "similar_skus")
    places = _first_similar(req.join(locs, F.col("r_location") == F.col("_l"), "left_anti"), locs, "r_location", "_l", n_similar, "similar_locations")
    m = master.select(F.col(sku).alias("r_sku")).distinct().withColumn("in_master", F.lit(True))
    out = (out.join(sim, "r_sku", "left").join(places, "r_location", "left").join(m, "r_sku", "left")
              .withColumn("in_master", F.coalesce("in_master", F.lit(False))))
    # the channels are few: one row, shown where the requested one is unknown
    out = clean.beside(out, chans.where(F.col("_c").isNotNull()).agg(F.array_join(F.array_sort(F.collect_set("_c")), "|").alias("_all")))
    unknown = lambda exists, value: ~F.col(exists) & (F.length(F.coalesce(value, F.lit(""))) > 0)
    warnings = combination_warnings(F.col("r_sku"), F.col("r_channel"), F.col("r_location"), ~F.col("sku_exists"), unknown("channel_exists", F.col("r_channel")),
                                    unknown("location_exists", F.col("r_location")), ~F.col("combination_exists"), ~F.col("in_master"))
    return (out.withColumn("available_channels", F.when(unknown("channel_exists", F.col("r_channel")), F.col("_all")))
               .withColumn("warnings", F.array_join(warnings, "|")).drop("_all"))


def dataset_structure(df: DataFrame) -> DataFrame:
    """Classify columns (date / metric / categorical / identifier) from
    name and unique ratio; null %, filter priority."""
    p = table_profile(df)
    lc = F.lower("column_name")
    ratio = F.col("n_unique") / F.col("total_rows")

    def any_of(hints):
        e = F.lit(False)
        for h in hints:
            e = e | lc.contains(h)
        return e
    cat = (F.when(any_of(DATE_HINTS_STRUCTURE), "date")
            .when(any_of(METRIC_HINTS_STRUCTURE), "metric")
            .when(ratio < 0.5, "categorical").otherwise("identifier"))
    prio = F.when(cat == "categorical", F.when(ratio < 0.05, "high").otherwise("medium"))
    return p.select("column_name", "data_type", "n_unique", "n_null",
                    (F.floor(F.col("n_null") * 100.0 / F.col("total_rows") * 100 + 0.5) / 100)
                    .alias("null_percentage"),
                    cat.alias("category"), prio.alias("filter_priority"), "duplicate_rows")


def detect_filters(df: DataFrame, most: int = 1000) -> DataFrame:
    """Columns usable as filters: not metric- or date-named, with
    1 < distinct <= min(most, rows / 2).  ``most`` is how many values a filter
    list may offer."""
    p = table_profile(df)
    lc = F.lower("column_name")
    bad = F.lit(False)
    for h in METRIC_HINTS_FILTER + DATE_HINTS_FILTER:
        bad = bad | lc.contains(h)
    ok = ~bad & (F.col("n_unique") > 1) & (F.col("n_unique") <= F.least(F.lit(float(most)),
                                                                         F.col("total_rows") * 0.5))
    return p.where(ok).select("column_name", F.col("n_unique").alias("unique_count"), "data_type")


def date_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per date column: min, max, span in days, null count."""
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    g = df.agg(*[x for c in cols for x in (F.min(F.col(c).cast("date")).alias(f"a__{c}"),
                                           F.max(F.col(c).cast("date")).alias(f"b__{c}"),
                                           F.count_if(F.col(c).isNull()).alias(f"n__{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"a__{c}").alias("min_date"),
                              F.col(f"b__{c}").alias("max_date"), F.col(f"n__{c}").alias("null_count"))
                     for c in cols])
    x = g.select(F.explode(rows).alias("r")).select("r.*")
    return x.withColumn("total_days", F.coalesce(F.date_diff("max_date", "min_date"), F.lit(0)))


def training_ready(df: DataFrame, k: Sequence[str], q: str, min_unique: int = 5) -> DataFrame:
    """Per series: rows, non-zero variance, at least min_unique values."""
    v = F.coalesce(F.col(q).cast("double"), F.lit(0.0))
    g = df.groupBy(*k).agg(F.count(F.lit(1)).alias("rows"), F.stddev_samp(v).alias("_sd"),
                           F.count_distinct(v).alias("n_unique"))
    return g.select(*k, "rows", "n_unique",
                    (F.coalesce("_sd", F.lit(0.0)) > 0).alias("has_variance"),
                    ((F.coalesce("_sd", F.lit(0.0)) > 0) & (F.col("n_unique") >= min_unique))
                    .alias("ready"))


def data_presence(df: DataFrame, key: str, ds: str, probe: Mapping[str, str],
                  n_keys: int = 10) -> DataFrame:
    """Rows, date range, the first n distinct keys, and the row counts
    matching each probe value exactly."""
    first = df.select(key).distinct().orderBy(key).limit(n_keys)
    keys = first.agg(F.array_join(F.array_sort(F.collect_list(key)), "|")).scalar()
    aggs = [F.count(F.lit(1)).alias("total_rows"), F.min(ds).alias("start_date"),
            F.max(ds).alias("end_date")]
    for c, v in probe.items():
        aggs.append(F.count_if(F.col(c) == F.lit(v)).alias(f"rows_{c}"))
    return df.agg(*aggs).withColumn("first_keys", keys)


def column_pattern_map(columns: Sequence[str], patterns: Mapping[str, Sequence[str]]) -> dict:
    """Map each role to the first column whose name contains one of the
    role's fragments (case-insensitive).  Pure schema work; yields the alias
    list that ``sources.map_columns`` consumes."""
    out = {}
    for role, frags in patterns.items():
        for c in columns:
            if any(f.lower() in c.lower() for f in frags):
                out[role] = c
                break
    return out
