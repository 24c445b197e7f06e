"""Joins: crosswalk, as-of, interval (promotion) and lookup joins.

Strategy is left to Catalyst/AQE except where noted.  Explicit broadcasts
only wrap sides whose size is bounded by construction (request lists,
top-k results).  Spark has no as-of or interval join; both are written as
equi-joins after a rewrite:

* as-of: distinct probe keys are unioned with the right side, bucketed by
  the tolerance, and ``last(payload, ignorenulls)`` over a per-(key, bucket)
  window finds the latest right row; the result is equi-joined back.
* interval: promotion intervals are exploded to (product, day) and
  pre-aggregated, then equi-joined on (product, day).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.columns import canon_id, norm_text
from ..session import cut_lineage
from . import clean
from .similar import budget_of, matching_ratio, similar_pairs

EPOCH = "1970-01-01"


# ------------------------------------------------------------------ crosswalk

def crosswalk_exact(left: DataFrame, right: DataFrame, left_col: str = "left_id",
                    right_col: str = "right_id") -> DataFrame:
    """Distinct ids joined on their canonical form, score 1.0."""
    a = left.select(F.col(left_col).alias("orders_product_id_raw")).where(
        F.col("orders_product_id_raw").isNotNull()).distinct() \
        .withColumn("canon_orders_pid", canon_id("orders_product_id_raw"))
    b = right.select(F.col(right_col).alias("inv_product_id_raw")).where(
        F.col("inv_product_id_raw").isNotNull()).distinct() \
        .withColumn("canon_inv_pid", canon_id("inv_product_id_raw"))
    return (a.join(b, F.col("canon_orders_pid") == F.col("canon_inv_pid"))
             .withColumn("method", F.lit("exact_canonical"))
             .withColumn("score", F.lit(1.0)))


def crosswalk_unmatched(left: DataFrame, exact: DataFrame, left_col: str = "left_id") -> DataFrame:
    """Left ids whose canonical form found no exact match."""
    a = left.select(F.col(left_col).alias("orders_product_id_raw")).where(
        F.col("orders_product_id_raw").isNotNull()).distinct() \
        .withColumn("canon_orders_pid", canon_id("orders_product_id_raw"))
    hit = exact.select("canon_orders_pid").distinct()
    return a.join(hit, "canon_orders_pid", "left_anti")


def fuzzy_candidates(left_ids: DataFrame, right_ids: DataFrame, min_ratio: float = 0.92) -> DataFrame:
    """Pairs of canonical ids that may reach the ratio, none lost (see ``similar``)."""
    return similar_pairs(left_ids, right_ids, "canon_orders_pid", "canon_inv_pid", min_ratio)


def crosswalk_fuzzy(unmatched: DataFrame, right: DataFrame, right_col: str = "right_id",
                    min_ratio: float = 0.92) -> DataFrame:
    """Best right id per unmatched left id with matching-block ratio >=
    min_ratio (ties: smallest right canonical id).  The ratio is that of whole
    strings: frequent characters of ids of 200 and more are not set aside."""
    b = right.select(F.col(right_col).alias("inv_product_id_raw")).where(
        F.col("inv_product_id_raw").isNotNull()).distinct() \
        .withColumn("canon_inv_pid", canon_id("inv_product_id_raw"))
    cands = fuzzy_candidates(unmatched, b, min_ratio)
    a, c = F.col("canon_orders_pid"), F.col("canon_inv_pid")
    scored = (cands.withColumn("score", matching_ratio(a, c, budget_of(F.length(a), F.length(c), min_ratio)))
                   .where(F.col("score") >= min_ratio))
    w = W.partitionBy("canon_orders_pid").orderBy(F.desc("score"), "canon_inv_pid")
    best = scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    raw_right = b.groupBy("canon_inv_pid").agg(F.min("inv_product_id_raw").alias("inv_product_id_raw"))
    return (unmatched.join(best, "canon_orders_pid")
                     .join(raw_right, "canon_inv_pid", "left")
                     .withColumn("method", F.lit("fuzzy_92")))


def crosswalk_best(pairs: DataFrame) -> DataFrame:
    """One mapping per canonical left id: highest score, ties by ids."""
    w = W.partitionBy("canon_orders_pid").orderBy(F.desc("score"), "orders_product_id_raw",
                                                  "inv_product_id_raw")
    cols = ["orders_product_id_raw", "inv_product_id_raw", "canon_orders_pid",
            "canon_inv_pid", "method", "score"]
    return (pairs.select(*cols).withColumn("_r", F.row_number().over(w))
                 .where("_r = 1").drop("_r"))


def build_crosswalk(left: DataFrame, right: DataFrame, left_col: str = "left_id",
                    right_col: str = "right_id", min_ratio: float = 0.92) -> DataFrame:
    """D01 + D02 + D03 + D04: exact first, fuzzy for the rest, best per id."""
    exact = crosswalk_exact(left, right, left_col, right_col)
    rest = crosswalk_unmatched(left, exact, left_col)
    fuzzy = crosswalk_fuzzy(rest, right, right_col, min_ratio)
    return crosswalk_best(exact.unionByName(fuzzy, allowMissingColumns=True))


def _mapping(cw: DataFrame, left: str, right: str, form) -> DataFrame:
    """One row (_k, _v) per left value in the given form; of several targets the smallest."""
    return (cw.where(F.col(left).isNotNull() & F.col(right).isNotNull())
              .groupBy(form(left).alias("_k")).agg(F.min(form(right)).alias("_v")))


def _mapped(df: DataFrame, col: str, mapping: DataFrame, form) -> DataFrame:
    return (df.withColumn("_k", form(col)).join(mapping, "_k", "left")
              .withColumn(col, F.coalesce(F.col("_v"), F.col("_k"))).drop("_k", "_v"))


def apply_crosswalk(df: DataFrame, cw: DataFrame, col: str = "product_id",
                    left_col: str = "canon_orders_pid", right_col: str = "canon_inv_pid") -> DataFrame:
    """Canonicalise ``col`` and replace it by its mapped id when mapped."""
    return _mapped(df, col, _mapping(cw, left_col, right_col, canon_id), canon_id)


def apply_city_crosswalk(df: DataFrame, cw: DataFrame, col: str = "city",
                         left_col: str = "orders_city", right_col: str = "inv_city") -> DataFrame:
    """D05, cities: lower case and trimmed, replaced by the mapped city when mapped."""
    return _mapped(df, col, _mapping(cw, left_col, right_col, norm_text), norm_text)


def align_sides(left: DataFrame, right: DataFrame, cw: DataFrame, product: str = "product_id", city: str = "city",
                products: tuple[str, str] = ("canon_orders_pid", "canon_inv_pid"),
                cities: tuple[str, str] = ("orders_city", "inv_city")) -> tuple[DataFrame, DataFrame]:
    """D05 on both sides of a join: the left side's ids (and cities, if the
    crosswalk and both sides have them) are mapped into the right side's, and
    both sides are brought into the same form."""
    if set(products) <= set(cw.columns):
        left = apply_crosswalk(left, cw, product, *products)
        right = right.withColumn(product, canon_id(product))
    if set(cities) <= set(cw.columns) and city in left.columns and city in right.columns:
        left = apply_city_crosswalk(left, cw, city, *cities)
        right = right.withColumn(city, norm_text(city))
    return left, right


# ------------------------------------------------------------------ as-of

def asof_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str],
              right_keys: Sequence[str] | None = None, left_ds: str = "ds",
              right_ds: str = "snapshot_date", tolerance_days: int | None = 90,
              payload: Sequence[str] | None = None, left_unique: bool = False) -> DataFrame:
    """For every left row, the latest right row with the same keys and
    date <= the left date, no older than ``tolerance_days``.  A null key or
    date matches nothing; such left rows stay, unmatched.

    Only distinct (keys, date) probes go through the window, so repeated left
    rows (a hot key) cost nothing extra there, and are joined back.  Where left
    rows are unique on keys and date (``left_unique``) whole rows go through it
    and the join back is saved.  With a tolerance, time is cut
    into buckets of that width; each right row is also copied into the next
    bucket, so a (key, bucket) window partition sees every candidate and a
    key's history is spread over many tasks."""
    right_keys = list(right_keys or left_keys)
    payload = list(payload or [c for c in right.columns if c not in right_keys + [right_ds]])
    kn = [f"_k{i}" for i in range(len(left_keys))]
    probes = left.select(*[F.col(c).alias(k) for c, k in zip(left_keys, kn)],
                         F.col(left_ds).alias("_d"),
                         *([F.struct(*left.columns).alias("_l")] if left_unique else []))
    complete = F.col("_d").isNotNull()
    for name in kn:
        complete = complete & F.col(name).isNotNull()
    if not left_unique:
        probes = probes.where(complete).distinct()
    probes = (probes.withColumn("_f", F.lit(1))
                  .withColumn("_p", F.lit(None).cast(
                      T.StructType([T.StructField("_rd", T.DateType())]
                                   + [right.schema[c] for c in payload]))))
    rs = right.select(*[F.col(c).alias(k) for c, k in zip(right_keys, kn)],
                      F.col(right_ds).alias("_d"), F.lit(0).alias("_f"),
                      F.struct(F.col(right_ds).cast("date").alias("_rd"),
                               *[F.col(c) for c in payload]).alias("_p")).where(complete)
    if all(f.dataType.typeName() not in ("map", "variant") for f in right.select(*payload).schema.fields):
        # one right row a key and date, the one that would win: a hot key's rows are pre-aggregated where they are read
        rs = rs.groupBy(*kn, "_d", "_f").agg(F.max("_p").alias("_p"))
    if left_unique:
        rs = rs.withColumn("_l", F.lit(None).cast(probes.schema["_l"].dataType))
    part = list(kn)
    if tolerance_days:
        bucket = F.floor(F.date_diff(F.col("_d"), F.lit(EPOCH).cast("date")) / tolerance_days)
        probes = probes.withColumn("_b", bucket)
        rs = rs.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
        part.append("_b")
    u = probes.unionByName(rs)
    w = (W.partitionBy(*part).orderBy("_d", "_f", "_p")
          .rowsBetween(W.unboundedPreceding, W.currentRow))
    m = (u.withColumn("_m", F.last("_p", ignorenulls=True).over(w))
          .where(F.col("_f") == 1))
    if tolerance_days:
        ok = F.date_diff(F.col("_d"), F.col("_m._rd")) <= tolerance_days
        m = m.withColumn("_m", F.when(ok, F.col("_m")))
    out_cols = [F.col("_m._rd").alias(right_ds if right_ds not in left.columns else f"{right_ds}_r")]
    for c in payload:
        out_cols.append(F.col(f"_m.{c}").alias(c if c not in left.columns else f"{c}_r"))
    if left_unique:
        return m.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *out_cols)
    m = m.select(*kn, "_d", *out_cols)
    cond = [F.col(c) == F.col(k) for c, k in zip(left_keys, kn)] + [F.col(left_ds) == F.col("_d")]
    return left.join(m, cond, "left").drop(*kn, "_d")


def match_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of rows where any of ``cols`` is non-null (one-row DataFrame)."""
    anyv = F.lit(False)
    for c in cols:
        anyv = anyv | F.col(c).isNotNull()
    return df.agg(F.avg(anyv.cast("double")).alias("rate"))


def _collapse_right(right: DataFrame, keys: Sequence[str], right_ds: str,
                    payload: Sequence[str]) -> DataFrame:
    """Right side at a coarser key: quantities summed per (keys, date), so
    that a product's stock is the total of its places.  Only for additive
    columns; others are to be joined at their own grain."""
    return right.groupBy(*keys, right_ds).agg(*[F.sum(c).alias(c) for c in payload])


def asof_cascade(left: DataFrame, right: DataFrame, candidates: Sequence[tuple],
                 left_ds: str = "ds", right_ds: str = "snapshot_date",
                 tolerance_days: int = 90, payload: Sequence[str] = ()) -> DataFrame:
    """D06 for each candidate (left keys, right keys) -- right side summed
    to that grain -- and of these the one with the best match rate (first
    candidate on ties).  ``payload`` must be additive.

    Every candidate's match is joined to the left rows (distinct probes only,
    so a product's many customers do not meet in one window) and the result is
    written once; the rates are one aggregate over that table, and the best
    candidate's columns are picked from it."""
    date_out = right_ds if right_ds not in left.columns else f"{right_ds}_r"
    out = left
    for i, (lk, rk) in enumerate(candidates):
        r = _collapse_right(right, rk, right_ds, payload).select(
            *rk, F.col(right_ds).alias(f"{right_ds}__{i}"), *[F.col(c).alias(f"{c}__{i}") for c in payload])
        out = asof_join(out, r, lk, rk, left_ds, f"{right_ds}__{i}", tolerance_days, [f"{c}__{i}" for c in payload])
    rates = []
    for i in range(len(candidates)):
        some = F.lit(False)
        for c in payload:
            some = some | F.col(f"{c}__{i}").isNotNull()
        rates.append(F.avg(some.cast("double")))
    out = cut_lineage(out)
    # the greatest (rate, earlier place) names the candidate
    best = out.agg(F.array_max(F.array(*[F.struct(F.coalesce(r, F.lit(0.0)).alias("rate"), F.lit(-i).alias("place"))
                                         for i, r in enumerate(rates)])).alias("b")).select((-F.col("b.place")).alias("_best"))
    out = clean.beside(out, best)
    pick = lambda c: F.element_at(F.array(*[F.col(f"{c}__{i}") for i in range(len(candidates))]), F.col("_best") + 1)
    return out.select(*left.columns, pick(right_ds).alias(date_out),
                      *[pick(c).alias(c if c not in left.columns else f"{c}_r") for c in payload])


def asof_coalesce(left: DataFrame, right: DataFrame, candidates: Sequence[tuple],
                  left_ds: str = "ds", right_ds: str = "snapshot_date",
                  tolerance_days: int = 90, payload: Sequence[str] = ()) -> DataFrame:
    """Per row, the first non-null match over the ordered key sets, the
    right side summed to each (``payload`` must be additive).  Distinct probes
    only go through the windows."""
    out = left
    names = []
    for i, (lk, rk) in enumerate(candidates):
        r = _collapse_right(right, rk, right_ds, payload)
        r = r.select(*rk, right_ds, *[F.col(c).alias(f"{c}__{i}") for c in payload])
        out = asof_join(out, r, lk, rk, left_ds, right_ds, tolerance_days,
                        [f"{c}__{i}" for c in payload])
        out = out.drop(right_ds if right_ds not in left.columns else f"{right_ds}_r")
        names.append(i)
    return out.select(*left.columns, *[F.coalesce(*[F.col(f"{c}__{i}") for i in names]).alias(c)
                                       for c in payload])


# Name fragments that mark date columns, and snapshot-like ones.
DATE_NAME_HINTS = ("date", "time", "timestamp", "updated", "asof", "as_of", "snapshot", "effective")
SNAPSHOT_HINTS = ("asof", "as_of", "snapshot", "effective")


def overlap_guard(right: DataFrame, left: DataFrame, left_ds: str = "ds") -> DataFrame:
    """Score each date-like right column by the share of its rows inside
    the left date window (+0.1 for snapshot-like names); mark the best one,
    unless it has no overlap at all."""
    cands = [c for c in right.columns if any(h in c.lower() for h in DATE_NAME_HINTS)]
    lo = left.agg(F.min(left_ds)).scalar()
    hi = left.agg(F.max(left_ds)).scalar()
    aggs = []
    for c in cands:
        d = F.col(c).cast("date")
        aggs += [F.avg(F.coalesce((d >= lo) & (d <= hi), F.lit(False)).cast("double")).alias(f"w__{c}"),
                 F.count(d).alias(f"n__{c}")]
    g = right.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"w__{c}").alias("within"),
                              F.col(f"n__{c}").alias("non_null"),
                              (F.col(f"w__{c}") + (0.1 if any(h in c.lower() for h in SNAPSHOT_HINTS)
                                                   else 0.0)).alias("score"))
                     for c in cands])
    x = g.select(F.explode(rows).alias("c")).select("c.*").where(F.col("non_null") > 0)
    best = x.orderBy(F.desc("score"), "column_name").limit(1)
    top = best.select("column_name").scalar()
    top_within = best.select("within").scalar()
    return x.withColumn("is_chosen", (F.col("column_name") == top) & (top_within > 0))


def static_median_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str],
                       right_keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per-key medians of right columns joined as ``{col}_static``
    (not leakage-safe: uses the whole right history)."""
    q = clean.quantiles(right, list(cols), [0.5], by=right_keys)    # exact, hot keys split by range
    med = q.select(*right_keys, *[F.col(c)[0].alias(f"{c}_static") for c in cols])
    cond = [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in zip(left_keys, right_keys)]
    return (left.alias("l").join(med.alias("r"), cond, "left")
                .select("l.*", *[F.col(f"r.{c}_static") for c in cols]))


# ------------------------------------------------------------------ intervals

def promo_days(promo: DataFrame, product: str = "product_id", start: str = "start_date",
               end: str = "end_date", discount: str = "discount",
               channel: str | None = None) -> DataFrame:
    """Promotion intervals exploded to one row per (product[, channel], day)
    with the largest discount of that day (1.0 where the calendar has no
    discount column: an indicator)."""
    keys = [norm_text(product).alias("_pk")] + ([norm_text(channel).alias("_ch")] if channel else [])
    # an interval that ends before it starts has no day (``sequence`` would count down)
    x = promo.where(F.col(start).cast("date") <= F.col(end).cast("date")).select(
        *keys, F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias("_day"),
        (F.coalesce(F.col(discount).cast("double"), F.lit(0.0)) if discount in promo.columns else F.lit(1.0)).alias("_disc"))
    return x.groupBy(*[c for c in ("_pk", "_ch") if c in x.columns], "_day") \
            .agg(F.max("_disc").alias("_disc"))


def promo_join(df: DataFrame, promo: DataFrame, ds: str = "ds", product: str = "product_id",
               channel: str | None = None, **promo_cols) -> DataFrame:
    """Per row, whether a promotion of its product (and channel) is active
    on its date (``is_promo_day``) and the largest such discount (``disc_pct``)."""
    days = promo_days(promo, channel=channel, **promo_cols)
    cond = [norm_text(product) == F.col("_pk"), F.col(ds) == F.col("_day")]
    if channel:
        cond.append(norm_text(channel) == F.col("_ch"))
    j = df.join(days, cond, "left")
    disc = F.coalesce(F.col("_disc"), F.lit(0.0))
    return (j.withColumn("disc_pct", disc).withColumn("is_promo_day", (disc > 0).cast("int"))
             .drop("_pk", "_ch", "_day", "_disc"))


def active_promotions(dates: DataFrame, promo: DataFrame, ds: str = "ds",
                      product: str = "product_id") -> DataFrame:
    """Every (row, promotion) pair whose interval covers the row's date
    (none for an interval that ends before it starts).

    The join is a sort-merge join: Spark's estimate of the days is that of the
    intervals, and a broadcast would collect every day of them on the driver."""
    days = promo.where(F.col("start_date") <= F.col("end_date")).select(norm_text("product_id").alias("_pk"), "promo_id", "start_date", "end_date",
                        "discount",
                        F.explode(F.sequence("start_date", "end_date")).alias("_day"))
    return (dates.join(days.hint("merge"), (norm_text(product) == F.col("_pk")) & (F.col(ds) == F.col("_day")))
                 .drop("_pk", "_day"))


# ------------------------------------------------------------------ lookups

def latest_attributes(grid: DataFrame, hist: DataFrame, keys: Sequence[str], cols: Sequence[str],
                      ds: str = "ds") -> DataFrame:
    """Attributes from the most recent history row of each key; null -> 0."""
    last = hist.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(ds)).alias("_a"))
    j = grid.join(last, list(keys), "left")
    return j.select(*grid.columns, *[F.coalesce(F.col(f"_a.{c}"), F.lit(0).cast(hist.schema[c].dataType))
                                     .alias(c) for c in cols])


def future_grid(combos: DataFrame, start, end, ds: str = "ds") -> DataFrame:
    """Every combo x every day of [start, end] (start/end may be columns);
    no day when end is before start."""
    s = F.lit(start).cast("date") if isinstance(start, str) else start
    e = F.lit(end).cast("date") if isinstance(end, str) else end
    return combos.withColumn(ds, F.explode(F.when(s <= e, F.sequence(s, e))))


def sku_lookup(df: DataFrame, master: DataFrame, key: str = "sku_id",
               order: Sequence[str] = ()) -> DataFrame:
    """Left join to the first master row of each key."""
    w = W.partitionBy(key).orderBy(*(order or [key]))
    first = master.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return df.join(first, key, "left")


def in_list_filter(df: DataFrame, filters: dict[str, Sequence[str]]) -> DataFrame:
    """case/space-insensitive membership in request lists (bounded lists:
    an ``In`` set evaluated in the scan stage, no join)."""
    cond = F.lit(True)
    for c, values in filters.items():
        vals = sorted({str(v).strip().lower() for v in values})
        cond = cond & norm_text(c).isin(vals)
    return df.where(cond)
