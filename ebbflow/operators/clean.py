"""Imputation, de-duplication, encoding, scaling and key derivation.

Column statistics (median, mode, min/max, mean/std) are computed in one
aggregate and enter the row-level projection as a scalar subquery -- Spark
evaluates it once and substitutes the value; no join, no driver loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import columns as fc
from ..session import cut_lineage


def scalars(one_row: DataFrame) -> dict[str, Column]:
    """Columns of a one-row DataFrame as scalar-subquery expressions.

    Every field reads the same one-struct subquery; the copies are identical
    plans, which adaptive execution reuses (``ReusedSubquery`` in the final
    plan), so the aggregate runs once however many fields are used."""
    s = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    return {c: s.getField(c) for c in one_row.columns}


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table (broadcast: one row by
    construction).  Unlike a scalar subquery, which is copied to every place
    that uses it, the row is computed once."""
    return df.crossJoin(F.broadcast(one_row))


def impute_ids(df: DataFrame, order_id: str = "order_id", product_id: str = "sku_id",
               content: Sequence[str] | None = None) -> DataFrame:
    """Missing-like ids replaced by ids derived from the row content
    (md5), so a re-run or a retried task yields the same id and exact
    duplicates stay duplicates."""
    content = list(content or df.columns)
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]))
    return df.withColumns({
        order_id: F.when(fc.is_missing_token(order_id), h).otherwise(F.col(order_id).cast("string")),
        product_id: F.when(fc.is_missing_token(product_id),
                           F.concat(F.lit("unknown_sku_"), F.substring(h, 1, 8)))
                     .otherwise(F.col(product_id).cast("string")),
    })


def impute_median_date(df: DataFrame, ds: str = "order_date") -> DataFrame:
    """Null dates take the median date (midpoint of the two middle days
    rounded down to a day)."""
    middle = quantiles(df, {"m": F.unix_date(F.col(ds).cast("date"))}, [0.5]).select(
        F.date_from_unix_date(F.floor(F.col("m")[0]).cast("int")).alias("_middle"))
    return beside(df, middle).withColumn(ds, F.coalesce(F.col(ds).cast("date"), "_middle")).drop("_middle")


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column (ties: smallest value), one
    row with one column per input column.  All columns in one scan: values
    are stacked as (column, value) and counted in one grouped aggregate
    (partial aggregation absorbs a hot value)."""
    cols = list(cols)
    stacked = (df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("string").alias("v"))
                                             for i, c in enumerate(cols)])).alias("s"))
                 .select("s._i", "s.v").where(F.col("v").isNotNull()))
    cnt = stacked.groupBy("_i", "v").agg(F.count(F.lit(1)).alias("n"))
    best = cnt.groupBy("_i").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("m"))
    return best.agg(*[F.first(F.when(F.col("_i") == i, F.col("m")), ignorenulls=True).alias(c)
                      for i, c in enumerate(cols)])


def impute_mode(df: DataFrame, cols: Sequence[str], default: str = "Unknown") -> DataFrame:
    """Null categories take the column mode, else ``default``."""
    m = scalars(modes(df, cols))
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), m[c], F.lit(default)) for c in cols})


def impute_constant(df: DataFrame, fills: Mapping[str, object] | None = None,
                    numeric: Sequence[str] = ()) -> DataFrame:
    """Constants for categorical gaps (customer -> 'anonymous'); numeric
    columns coerced (unparsable -> null) and null -> 0.0."""
    fills = dict(fills or {"customer": "anonymous"})
    out = {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in fills.items() if c in df.columns}
    out.update({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numeric
                if c in df.columns})
    return df.withColumns(out)


#: Sketch accuracy, half width of a bracket (in shares of the rows), rows up to which all values are counted, parts of a bracket.
SKETCH, BRACKET, FEW, PARTS = 10_000, 0.001, 2_000, 4_096


def quantiles(df: DataFrame, cols, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """For every column an array of its exact linear percentiles at ``probs``
    (Spark's ``percentile`` values; null when the column is all null): one
    row, or one row per group of ``by``.  ``cols`` is a list of names or a
    dict name -> Column.

    Spark's exact ``percentile`` merges one counter per distinct value in a
    single task per group -- unbounded for continuous columns or a hot group.
    Here a mergeable sketch first brackets the values around each percentile
    (0.2 % of the rows; all rows of small groups).  Then values in the bracket
    are counted one by one and all values below it as one, so partial
    aggregation leaves little to shuffle; the bracket's counts are summed in
    PARTS equal intervals, and only the interval with the wanted rank is
    ranked value by value.  Nothing runs before an action."""
    by = list(by)
    items = list(cols.items()) if isinstance(cols, dict) else [(c, F.col(c)) for c in cols]
    ends = [x for p in probs for x in (max(0.0, p - BRACKET), min(1.0, p + BRACKET))]
    sketch = []
    for i, (_, e) in enumerate(items):
        v = e.cast("double")
        sketch += [F.count(v).alias(f"_n{i}"), F.min(v).alias(f"_l{i}"), F.max(v).alias(f"_h{i}"),
                   F.percentile_approx(v, F.array(*[F.lit(float(x)) for x in ends]), SKETCH).alias(f"_e{i}")]
    small = lambda i: F.col(f"_n{i}") <= FEW
    wanted = [F.struct(
        F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(f"_n{i}").alias("_n"), ((F.col(f"_n{i}") - 1) * F.lit(float(p))).alias("_pos"),
        F.when(small(i), F.col(f"_l{i}")).otherwise(F.col(f"_e{i}")[2 * j]).alias("_low"),
        F.when(small(i), F.col(f"_h{i}")).otherwise(F.col(f"_e{i}")[2 * j + 1]).alias("_high"))
        for i in range(len(items)) for j, p in enumerate(probs)]
    brackets = (df.groupBy(*by).agg(*sketch).select(*[F.col(c).alias(f"_t_{c}") for c in by], F.explode(F.array(*wanted)).alias("_b"))
                .select(*[f"_t_{c}" for c in by], "_b.*").where("_n > 0"))
    values = (df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("_vi"), e.cast("double").alias("_v"))
                                                 for i, (_, e) in enumerate(items)])).alias("_s"))
                .select(*by, "_s._vi", "_s._v").where(F.col("_v").isNotNull()))
    on = [values["_vi"] == brackets["_i"], values["_v"] <= brackets["_high"]] + [values[c].eqNullSafe(brackets[f"_t_{c}"]) for c in by]
    met = values.join(brackets if by else F.broadcast(brackets), on)       # without groups: one row a column and percentile
    g = [f"_t_{c}" for c in by] + ["_i", "_j"]
    fixed = ["_pos", "_low", "_high"]
    width = F.col("_high") - F.col("_low")
    part = F.when(F.col("_v").isNull(), -1).when(width > 0, F.coalesce(F.floor((F.col("_v") - F.col("_low")) / width * (PARTS - 1)), F.lit(0))) \
        .otherwise(0).cast("int")
    counts = (met.select(*g, *fixed, F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v"))
                 .groupBy(*g, *fixed, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_part", part))
    before = lambda *order: F.coalesce(F.sum("_c").over(
        W.partitionBy(*g, *order[:-1]).orderBy(order[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    holds = lambda low: (low <= F.ceil("_pos")) & (F.floor("_pos") < low + F.col("_c"))
    parts = (counts.groupBy(*g, "_pos", "_part").agg(F.sum("_c").alias("_c")).withColumn("_off", before("_part")).where(holds(F.col("_off"))))
    p = parts.select(*[F.col(c).alias(f"_p{c}") for c in [*g, "_part"]], "_off")
    near = counts.join(p, [counts[c].eqNullSafe(p[f"_p{c}"]) for c in [*g, "_part"]])
    ranked = near.withColumn("_lo", F.col("_off") + before("_part", "_v")).where(holds(F.col("_lo")))
    at = lambda rank: F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_lo") + F.col("_c")), F.col("_v")))
    low, high = F.floor("_pos"), F.ceil("_pos")
    per = ranked.groupBy(*g, "_pos").agg(at(low).alias("_a"), at(high).alias("_z"))
    a, z = F.col("_a"), F.col("_z")
    missed = F.raise_error(F.lit("a percentile lies outside the bracket of its sketch")).cast("double")
    value = (F.when(a.isNull() | z.isNull(), missed).when((low == high) | (a == z), a)
             .otherwise((high - F.col("_pos")) * a + (F.col("_pos") - low) * z))
    per = per.select(*g, value.alias("_q"))
    some = lambda i, j: F.max(F.when((F.col("_i") == i) & (F.col("_j") == j), F.col("_q")))
    known = lambda i: F.max(F.when(F.col("_i") == i, F.lit(1)))
    out = [F.when(known(i) == 1, F.array(*[some(i, j) for j in range(len(probs))])).alias(name) for i, (name, _) in enumerate(items)]
    if not by:
        return per.agg(*out)
    # groups whose columns are all null have no values: keep them (null arrays)
    groups = df.select(*by).distinct()
    r = per.groupBy(*[f"_t_{c}" for c in by]).agg(*out)
    return (groups.join(r, [groups[c].eqNullSafe(r[f"_t_{c}"]) for c in by], "left")
                  .drop(*[f"_t_{c}" for c in by]))


def medians(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """One row: the median of every column (null when all null).

    Exact medians are selected within sketched brackets (``quantiles``);
    ``approx=True`` takes the sketch's own values instead."""
    if approx:
        return df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10000).alias(c) for c in cols])
    q = quantiles(df, list(cols), [0.5])
    return q.select(*[F.col(c)[0].alias(c) for c in cols])


def impute_median(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
                  approx: bool = False) -> DataFrame:
    """Null numerics take the median (of ``fit``, e.g. the training
    split, else of ``df``); 0 when the column is all null."""
    m = medians(fit if fit is not None else df, cols, approx)
    x = beside(df, m.select(*[F.col(c).alias(f"_median_{c}") for c in cols]))
    return (x.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_median_{c}"), F.lit(0.0)) for c in cols})
             .drop(*[f"_median_{c}" for c in cols]))


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows."""
    return df.dropDuplicates()


def label_codes(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """Mapping value -> code = rank of the value among the sorted distinct
    values (from 0), computed without funnelling values through one task:
    distinct values are range-partitioned and sorted, checkpointed (so the
    layout is fixed), counted per partition, and each value's code is its
    partition's offset plus its position inside the partition."""
    vals = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(vals.repartitionByRange(n, "value").sortWithinPartitions("value")
                             .withColumn("_pid", F.spark_partition_id())
                             .withColumn("_mid", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    # one row per partition: the running total is a window over <= n rows
    offs = counts.withColumn("_off", F.sum("_c").over(W.orderBy("_pid").rowsBetween(
        W.unboundedPreceding, -1))).fillna(0, ["_off"])
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (ranged.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
                  .select("value", (F.col("_off") + local).cast("int").alias("code")))


def running_offsets(blocks: DataFrame, order: Sequence[str], weight: str,
                    partitions: int | None = None) -> DataFrame:
    """``blocks`` plus ``_off`` = sum of ``weight`` over all rows strictly
    before each row in ``order`` (rows must be unique on ``order``).

    Same layout as ``label_codes``: rows are range-partitioned on ``order``
    and checkpointed, so partition ids follow the order; a partition's offset
    is a running total over one row per partition, a row's offset inside it a
    window over that partition only -- no task sees more than one range."""
    order = list(order)
    n = partitions or max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(blocks.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(F.sum(weight).alias("_t"))
    pid_off = totals.select("_pid", F.coalesce(F.sum("_t").over(
        W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_poff"))
    inner = F.coalesce(F.sum(weight).over(W.partitionBy("_pid").orderBy(*order)
                                          .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (ranged.join(F.broadcast(pid_off), "_pid")          # <= n rows: bounded broadcast
                  .withColumn("_off", F.col("_poff") + inner).drop("_pid", "_poff"))


def label_encode(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``{col}_enc`` integer codes plus the mapping table per column."""
    maps = {c: label_codes(df, c) for c in cols}
    out = df
    for c, m in maps.items():
        out = (out.join(m.withColumnRenamed("value", f"_v_{c}").withColumnRenamed("code", f"{c}_enc"),
                        F.col(c).cast("string") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}"))
    return out, maps


def scale_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) as ``{col}_MinMax``; constant column -> 0."""
    s = scalars(df.agg(*[F.min(c).alias(f"a_{c}") for c in cols],
                       *[F.max(c).alias(f"b_{c}") for c in cols]))
    out = {}
    for c in cols:
        rng = s[f"b_{c}"] - s[f"a_{c}"]
        out[f"{c}_MinMax"] = F.when(rng == 0, F.lit(0.0)).otherwise((F.col(c) - s[f"a_{c}"]) / rng)
    return df.withColumns(out)


def scale_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std as ``{col}_Standard``; constant -> 0."""
    s = scalars(df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                       *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))
    out = {}
    for c in cols:
        sd = s[f"s_{c}"]
        out[f"{c}_Standard"] = F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - s[f"m_{c}"]) / sd)
    return df.withColumns(out)


def one_hot(df: DataFrame, cols: Sequence[str], codes: Sequence[str] = (),
            levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Indicator columns (first level dropped) for ``cols``; integer codes
    (C07) for the wide columns named in ``codes``.  The caller says which is
    which, so the data never decides the output columns by its size.

    ``levels`` lists a column's values; where it is missing they are read,
    sorted, once while the plan is made (they name the output columns)."""
    out = df
    for c in cols:
        known = (levels or {}).get(c)
        if known is None:
            known = [r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().orderBy(1).collect()]
        out = out.withColumns({f"{c}_{v}": (F.col(c).cast("string") == v).cast("int") for v in known[1:]}).drop(c)
    for c in codes:
        m = label_codes(df, c)
        out = (out.join(m.withColumnRenamed("value", "_v"), F.col(c).cast("string") == F.col("_v"),
                        "left").drop(c, "_v").withColumnRenamed("code", c))
    return out


def one_hot_sparse(df: DataFrame, cols: Sequence[str], suffix: str = "_onehot") -> tuple[DataFrame, dict[str, DataFrame]]:
    """C10 for wide columns: one sparse indicator vector a column (first level
    dropped; nulls are all 0) and, per column, the table of its levels with
    their codes (C07).  Code n > 0 stands at place (levels - 1 - n).

    Levels stay a distributed table: their codes are joined to the rows, and
    MLlib's encoder learns one number a column, so no list of them reaches the
    driver and the schema does not depend on the data."""
    from pyspark.ml.feature import OneHotEncoder
    out, maps = df, {}
    for c in cols:
        m = label_codes(df, c)
        most = m.agg(F.greatest(F.coalesce(F.max("code"), F.lit(0)), F.lit(1)).alias("_most"))
        places = beside(m, most).select(F.col("value").alias("_v"), (F.col("_most") - F.col("code")).alias("_place"))
        out = out.join(places, F.col(c).cast("string") == F.col("_v"), "left").drop("_v")
        out = beside(out, most).withColumn("_place", F.coalesce("_place", "_most").cast("double")).drop("_most")    # null: as the dropped level
        # the encoder learns the largest place; a table of places is all that it has to see
        ends = F.array(F.lit(0.0), F.col("_most").cast("double"))
        fit_on = most.select(F.explode(ends).alias("_place"))
        encoder = OneHotEncoder(inputCol="_place", outputCol=f"{c}{suffix}", dropLast=True).fit(fit_on)
        out, maps[c] = encoder.transform(out).drop("_place", c), m
    return out, maps


def date_to_epoch(df: DataFrame) -> DataFrame:
    """C11: date/timestamp columns to epoch seconds; remaining numeric nulls -> -1."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.unix_timestamp(F.col(f.name).cast("timestamp")).cast("long")
    x = df.withColumns(out)
    fill = {}
    for f in x.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            fill[f.name] = F.coalesce(F.col(f.name), F.lit(-1).cast(f.dataType))
    return x.withColumns(fill)


def canonical_ids(df: DataFrame, text_cols: Sequence[str] = (), id_cols: Sequence[str] = ()) -> DataFrame:
    """lower+trim text keys; product ids also lose non-alphanumerics and
    leading zeros."""
    out = {c: fc.norm_text(c) for c in text_cols}
    out.update({c: fc.canon_id(c) for c in id_cols})
    return df.withColumns(out)


def safe_floats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null / NaN / infinite / unparsable -> 0.0."""
    return df.withColumns({c: fc.safe_float(c) for c in cols})


def format_dates(df: DataFrame, as_json: bool = True) -> DataFrame:
    """C14: dates to ISO text; optionally each row as one JSON document."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss")
    x = df.withColumns(out)
    if as_json:
        return x.select(F.to_json(F.struct(*x.columns)).alias("json"))
    return x


def calendar_features(df: DataFrame, ds: str) -> DataFrame:
    """C15."""
    return df.withColumns(fc.calendar_columns(ds))


def cyclical_features(df: DataFrame, ds: str) -> DataFrame:
    """C16."""
    return df.withColumns(fc.cyclical_columns(ds))


# SKU prefix -> brand, then substring tests in order.
BRAND_PREFIX = {"HUG": "Huggies", "KLX": "Kleenex", "SCT": "Scott", "KTX": "Kotex",
                "DEP": "Depend", "PSE": "Poise"}
BRAND_CONTAINS = (("Huggies", ("HUG", "HUGG", "H")), ("Kleenex", ("KLX", "KLE", "KLEEN")),
                  ("Scott", ("SCT", "SCO", "SCOTT")), ("Kotex", ("KTX", "KOT", "KOTEX")),
                  ("Depend", ("DEP", "DEPEND")))


def brand_from_sku(df: DataFrame, sku: str = "sku_id", mode: str = "prefix") -> DataFrame:
    """C17: brand from the three-letter SKU prefix ('Other' when unknown);
    ``mode='contains'`` uses the substring tests instead."""
    s = F.upper(F.col(sku).cast("string"))
    if mode == "prefix":
        e = F.coalesce(F.create_map(*[x for k, v in BRAND_PREFIX.items() for x in (F.lit(k), F.lit(v))])
                       [F.substring(F.col(sku).cast("string"), 1, 3)], F.lit("Other"))
    else:
        e = None
        for brand, frags in BRAND_CONTAINS:
            cond = F.lit(False)
            for fr in frags:
                cond = cond | s.contains(fr)
            e = F.when(cond, brand) if e is None else e.when(cond, brand)
        e = e.otherwise("Other")
    return df.withColumn("brand", e)


def row_keys(df: DataFrame, sku: str = "sku_id", location: str = "location",
             channel: str = "channel", ds: str = "order_date") -> DataFrame:
    """Forecast id ``{sku}_{location}_{channel}_{yyyyMMdd}`` and a series id."""
    return df.withColumns({
        "forecast_id": F.concat_ws("_", F.col(sku), F.col(location), F.col(channel),
                                   F.date_format(ds, "yyyyMMdd")),
        "series_id": F.concat_ws("_", F.col(sku), F.col(location), F.col(channel)),
    })


def scenario_hash(items: Mapping[str, float]) -> str:
    """Deterministic scenario key: md5 of the sorted (name, value) list, 12 hex."""
    import hashlib
    return hashlib.md5(str(sorted(items.items())).encode()).hexdigest()[:12]


def aggregation_key(level: str, filters: Mapping[str, str | None]) -> str:
    """Request key ``level_sku_brand_category_location_channel_customer``."""
    parts = [level] + [filters.get(k) or "all" for k in
                       ("sku_id", "brand", "category", "location", "channel", "customer")]
    return "_".join(parts)
