"""Leakage-aware lag, rolling and inventory-proxy features.

Input is a table unique on (keys, ds) -- e.g. ``daily_series`` -- so that a
row frame is well defined.  Every feature uses the same
``Window.partitionBy(keys).orderBy(ds)`` spec: Spark plans one exchange and
one sort for all of them (``window_features`` computes E01-E14 together).
A series is bounded by its number of days, so no window partition grows with
the fact table; line-grain skew is removed by the daily aggregation upstream.

"Past only" frames end at the previous row (``rowsBetween(-n, -1)``).
Minimum-period rules are a ``count`` over the same frame beside the aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import EPS, r6

K = ["customer_id", "product_id"]
DS = "ds"
Q = "order_qty"
# Default lag spec (column -> feature prefix, lags).
LAG_SPEC = {"order_qty": ("qty", (1, 7)), "revenue": ("revenue", (1, 7)),
            "discount_percent": ("discount_percent", (1,)), "price": ("price", (1,))}
ROLL_SPEC = {"order_qty": "qty", "revenue": "revenue"}


def _w(k, ds):
    return W.partitionBy(*(K if k is None else k)).orderBy(ds)


def _frame(k, ds, lo, hi):
    return _w(k, ds).rowsBetween(lo, hi)


def _guarded_avg(c, w, min_n: int) -> Column:
    return F.when(F.count(c).over(w) >= min_n, F.avg(c).over(w))


def lag_columns(k=None, ds: str = DS, spec: Mapping = None) -> dict[str, Column]:
    """``{prefix}_lag_{n}`` columns."""
    w = _w(k, ds)
    out = {}
    for c, (prefix, ns) in (spec or LAG_SPEC).items():
        for n in ns:
            out[f"{prefix}_lag_{n}"] = F.lag(c, n).over(w)
    return out


def lags(df: DataFrame, k=None, ds: str = DS, spec: Mapping = None) -> DataFrame:
    spec = {c: v for c, v in (spec or LAG_SPEC).items() if c in df.columns}
    return df.withColumns(lag_columns(k, ds, spec))


def rolling_columns(k=None, ds: str = DS, window: int = 7, past_only: bool = False,
                    spec: Mapping = None) -> dict[str, Column]:
    """E02 (frame ends at the current row, as the reference computes it) and
    E03 (``past_only``: frame ends at the previous row)."""
    lo, hi = (-window, -1) if past_only else (-(window - 1), 0)
    w = _frame(k, ds, lo, hi)
    out = {}
    for c, prefix in (spec or ROLL_SPEC).items():
        sfx = f"_{window}_past" if past_only else f"_{window}"
        out[f"{prefix}_rolling_mean{sfx}"] = r6(F.avg(c).over(w))
        out[f"{prefix}_rolling_std{sfx}"] = r6(F.stddev_samp(c).over(w))
    return out


def rolling(df: DataFrame, k=None, ds: str = DS, window: int = 7, past_only: bool = False,
            spec: Mapping = None) -> DataFrame:
    spec = {c: v for c, v in (spec or ROLL_SPEC).items() if c in df.columns}
    return df.withColumns(rolling_columns(k, ds, window, past_only, spec))


def series_lags(df: DataFrame, k=None, ds: str = DS, q: str = Q,
                ns: Sequence[int] = (1, 3, 7, 14)) -> DataFrame:
    """Lags with a missing lag replaced by the series mean."""
    w = _w(k, ds)
    mean = F.avg(q).over(W.partitionBy(*(K if k is None else k)))
    return df.withColumns({f"lag_{n}": r6(F.coalesce(F.lag(q, n).over(w), mean)) for n in ns})


def rolling_multi(df: DataFrame, k=None, ds: str = DS, q: str = Q,
                  windows: Sequence[int] = (3, 7, 14)) -> DataFrame:
    """Per window incl. the current row: mean, std (0 when undefined) and
    the mean of first differences (first difference 0)."""
    w = _w(k, ds)
    x = df.withColumn("_diff", F.coalesce(F.col(q) - F.lag(q, 1).over(w), F.lit(0.0)))
    cols = {}
    for n in windows:
        f = _frame(k, ds, -(n - 1), 0)
        cols[f"rolling_mean_{n}"] = r6(F.avg(q).over(f))
        cols[f"rolling_std_{n}"] = r6(F.coalesce(F.stddev_samp(q).over(f), F.lit(0.0)))
        cols[f"rolling_trend_{n}"] = r6(F.avg("_diff").over(f))
    return x.withColumns(cols).drop("_diff")


def past_mean_col(k=None, ds: str = DS, q: str = Q, n: int = 14, min_n: int = 3) -> Column:
    """Mean of the previous n rows when at least min_n exist, else 0."""
    return F.coalesce(_guarded_avg(q, _frame(k, ds, -n, -1), min_n), F.lit(0.0))


# Inventory columns that add up to what is on hand.
ON_HAND_COLUMNS = ("customer_inventory_qty", "current_inventory_units", "warehouse_inventory_qty")


def on_hand(df: DataFrame) -> DataFrame:
    """E07 input: ``on_hand_qty`` as it is, else the sum of the inventory
    columns that are present (nulls count 0), else 0."""
    if "on_hand_qty" in df.columns:
        return df
    present = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ON_HAND_COLUMNS if c in df.columns]
    return df.withColumn("on_hand_qty", sum(present[1:], present[0]) if present else F.lit(0.0))


def supply_columns(on_hand: Column, roll14: Column) -> dict[str, Column]:
    """Days of supply clipped to 0..365 and the stock-out flag."""
    dos = F.least(F.greatest(on_hand / (roll14 + EPS), F.lit(0.0)), F.lit(365.0))
    return {"on_hand_qty": on_hand, "days_of_supply": r6(dos),
            "stockout_flag": (on_hand <= 0).cast("int")}


def days_since_positive_col(k=None, ds: str = DS, q: str = Q) -> Column:
    """Days since the last row whose previous row had q > 0 (999 if none)."""
    w = _w(k, ds)
    marked = F.when(F.lag(q, 1).over(w) > 0, F.col(ds))
    last = F.last(marked, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    days = F.coalesce(F.date_diff(F.col(ds), last), F.lit(999))
    return F.least(F.greatest(days, F.lit(0)), F.lit(999)).cast("int")


def zero_streak(df: DataFrame, k=None, ds: str = DS, q: str = Q) -> DataFrame:
    """Run of consecutive zero-q rows ending at the previous row.

    Gaps and islands in one window: streak = row number minus the row number
    of the latest row that does not extend the run."""
    w = _w(k, ds)
    x = (df.withColumn("_z", F.coalesce(F.lag(q, 1).over(w) == 0, F.lit(False)))
           .withColumn("_rn", F.row_number().over(w)))
    brk = F.last(F.when(~F.col("_z"), F.col("_rn")), ignorenulls=True) \
        .over(w.rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("zero_streak", (F.col("_rn") - F.coalesce(brk, F.lit(0))).cast("int")) \
            .drop("_z", "_rn")


def trend_col(m7: str, k=None, ds: str = DS) -> Column:
    """m7 minus m7 seven rows earlier, 0 when undefined."""
    return r6(F.coalesce(F.col(m7) - F.lag(m7, 7).over(_w(k, ds)), F.lit(0.0)))


def cv_col(k=None, ds: str = DS, q: str = Q, n: int = 28, min_n: int = 7) -> Column:
    """std/(mean + 1e-6) of the previous n rows (min_n), clipped 0..10, else 0."""
    f = _frame(k, ds, -n, -1)
    ok = F.count(q).over(f) >= min_n
    cv = F.stddev_samp(q).over(f) / (F.avg(q).over(f) + EPS)
    return r6(F.least(F.greatest(F.coalesce(F.when(ok, cv), F.lit(0.0)), F.lit(0.0)), F.lit(10.0)))


def price_ratio_col(k=None, ds: str = DS, price: str = "price", n: int = 28,
                    min_n: int = 7) -> Column:
    """Previous price / (median of the previous n prices + 1e-6), else 1.

    ``percentile`` accepts a row frame (``median`` does not on 4.1)."""
    f = _frame(k, ds, -n, -1)
    med = F.when(F.count(price).over(f) >= min_n, F.percentile(price, 0.5).over(f))
    ratio = F.lag(price, 1).over(_w(k, ds)) / (med + EPS)
    return r6(F.coalesce(ratio, F.lit(1.0)))


def prev_spike_col(k=None, ds: str = DS, q: str = Q) -> Column:
    """1 when the previous q exceeds 1.5 x the mean of the 7 rows before it (min 4)."""
    base = _guarded_avg(q, _frame(k, ds, -8, -2), 4)
    prev = F.lag(q, 1).over(_w(k, ds))
    return F.coalesce(prev > 1.5 * (base + EPS), F.lit(False)).cast("int")


def window_features(df: DataFrame, k=None, ds: str = DS, q: str = Q,
                    price: str | None = "price", on_hand: str | None = None) -> DataFrame:
    """E01-E14 in one pass (one exchange, one sort per series)."""
    x = lags(df, k, ds)
    x = rolling(x, k, ds, 7, past_only=False)
    x = rolling(x, k, ds, 7, past_only=True)
    w = _w(k, ds)
    z = F.coalesce(F.lag(q, 1).over(w) == 0, F.lit(False))
    x = x.withColumns({
        "qty_roll14": r6(past_mean_col(k, ds, q)),
        "_m7": _guarded_avg(q, _frame(k, ds, -7, -1), 4),
        "_z": z, "_rn": F.row_number().over(w),
        "days_since_pos_order": days_since_positive_col(k, ds, q),
        "qty_cv_28": cv_col(k, ds, q),
        "prev_spike_7": prev_spike_col(k, ds, q),
    })
    f28 = _frame(k, ds, -27, 0)
    zd = F.col("_z").cast("double")
    brk = F.last(F.when(~F.col("_z"), F.col("_rn")), ignorenulls=True) \
        .over(w.rowsBetween(W.unboundedPreceding, 0))
    cols = {
        "zero_streak": (F.col("_rn") - F.coalesce(brk, F.lit(0))).cast("int"),
        "zero_share_28": r6(F.coalesce(F.when(F.count(F.lit(1)).over(f28) >= 7, F.avg(zd).over(f28)),
                                       F.lit(0.0))),
        "qty_trend_14": r6(F.coalesce(F.col("_m7") - F.lag("_m7", 7).over(w), F.lit(0.0))),
    }
    if price and price in df.columns:
        cols["price_ratio_28"] = price_ratio_col(k, ds, price)
    x = x.withColumns(cols)
    if on_hand is not None:
        x = x.withColumns(supply_columns(F.coalesce(F.col(on_hand), F.lit(0.0)),
                                         F.col("qty_roll14")))
    return x.drop("_m7", "_z", "_rn")


def single_feature(df: DataFrame, name: str, k=None, ds: str = DS, q: str = Q) -> DataFrame:
    """One of E06, E08-E14 alone (same definitions as ``window_features``)."""
    full = window_features(df, k, ds, q)
    keys = list(K if k is None else k)
    return full.select(*keys, ds, q, name)


# ---------------------------------------------------------------- per-series tails

def _rev(k, ds):
    return W.partitionBy(*(K if k is None else k)).orderBy(F.desc(ds))


def tail_features(df: DataFrame, k=None, ds: str = DS, q: str = Q,
                  lags_: Sequence[int] = (1, 3, 7, 14), wins: Sequence[int] = (3, 7, 14)) -> DataFrame:
    """Per series, the last values at the given lags and mean / std /
    mean first difference of the last 3, 7, 14 rows (series mean, 0, 0 when
    shorter).  One reverse row number and one conditional aggregate."""
    keys = list(K if k is None else k)
    x = df.withColumn("_rd", F.row_number().over(_rev(k, ds)))
    # first difference inside a tail of length w: q(rd) - q(rd+1), first of tail 0
    x = x.withColumn("_next", F.lead(q, 1).over(_rev(k, ds)))
    aggs = [F.count(F.lit(1)).alias("_n"), F.avg(q).alias("_mean"), F.max(ds).alias("last_date")]
    for n in lags_:
        aggs.append(F.max(F.when(F.col("_rd") == n, F.col(q))).alias(f"_lag_{n}"))
    for n in wins:
        inside = F.col("_rd") <= n
        aggs += [F.avg(F.when(inside, F.col(q))).alias(f"_m{n}"),
                 F.stddev_samp(F.when(inside, F.col(q))).alias(f"_s{n}"),
                 F.sum(F.when(F.col("_rd") < n, F.col(q) - F.col("_next"))).alias(f"_d{n}")]
    g = x.groupBy(*keys).agg(*aggs)
    n_ = F.col("_n")
    out = [*keys, "last_date", r6(F.col("_mean")).alias("series_mean")]
    for n in lags_:
        out.append(r6(F.when(n_ >= n, F.col(f"_lag_{n}")).otherwise(F.col("_mean"))).alias(f"lag_{n}"))
    for n in wins:
        full = n_ >= n
        out += [r6(F.when(full, F.col(f"_m{n}")).otherwise(F.col("_mean"))).alias(f"rolling_mean_{n}"),
                r6(F.when(full, F.coalesce(F.col(f"_s{n}"), F.lit(0.0))).otherwise(0.0))
                .alias(f"rolling_std_{n}"),
                r6(F.when(full, F.coalesce(F.col(f"_d{n}"), F.lit(0.0)) / n).otherwise(0.0))
                .alias(f"rolling_trend_{n}")]
    return g.select(*out)


def history_tail(df: DataFrame, n: int, k=None, ds: str = DS) -> DataFrame:
    """The last n rows of every series."""
    return (df.withColumn("_rd", F.row_number().over(_rev(k, ds)))
              .where(F.col("_rd") <= n).drop("_rd"))


def recent_combos(df: DataFrame, days: int = 28, k=None, ds: str = DS) -> DataFrame:
    """Distinct series seen in the last ``days`` days before the last date.

    (The reference's fallback to the latest 1000 combos cannot trigger: the
    row holding the last date is always inside the window.)"""
    keys = list(K if k is None else k)
    last = df.agg(F.max(ds)).scalar()
    return df.where(F.col(ds) > F.date_sub(last, days)).select(*keys).distinct()


def recent_signal_window(df: DataFrame, k=None, ds: str = DS, q: str = Q,
                         max_rows: int | None = None, min_nonzero: int = 50,
                         blocks: Sequence[int] = (100_000, 60_000, 40_000, 20_000, 10_000,
                                                  5_000, 2_000)) -> DataFrame:
    """Per series, rows up to the last non-zero row; of those, the largest
    block (all of them, or one of ``blocks``) ending there with at least
    ``min_nonzero`` non-zero rows and variance; else all of them.  Series with
    no signal keep all rows.  ``max_rows`` bounds blocks where a caller wants
    the single-machine limit; by default no series loses a row to it."""
    keys = list(K if k is None else k)
    blocks = [b for b in sorted({min(b, max_rows or b) for b in blocks}, reverse=True)]
    max_rows = max_rows or 2 ** 31 - 1
    blocks = [max_rows] + [b for b in blocks if b < max_rows]
    pos = F.row_number().over(_w(k, ds))
    x = df.withColumn("_pos", pos)
    sig = F.max(F.when(F.coalesce(F.col(q), F.lit(0.0)) > 0, F.col("_pos"))) \
        .over(W.partitionBy(*keys))
    tot = F.count(F.lit(1)).over(W.partitionBy(*keys))
    x = x.withColumn("_end", sig).withColumn("_tot", tot)
    # rows counted back from the anchor (1 = the anchor row); none after it
    x = x.withColumn("_back", F.col("_end") - F.col("_pos") + 1)
    val = F.coalesce(F.col(q), F.lit(0.0))
    aggs = []
    for b in blocks:
        size = F.least(F.lit(min(b, max_rows)), F.col("_end"))
        inb = (F.col("_back") >= 1) & (F.col("_back") <= size)
        aggs += [F.count_if(inb & (val > 0)).alias(f"_nz{b}"),
                 F.stddev_samp(F.when(inb, val)).alias(f"_sd{b}")]
    g = x.groupBy(*keys).agg(F.max("_end").alias("_end"), *aggs)
    chosen = None
    for b in blocks:
        ok = (F.col(f"_nz{b}") >= min_nonzero) & (F.coalesce(F.col(f"_sd{b}"), F.lit(0.0)) > 0)
        size = F.least(F.lit(min(b, max_rows)), F.col("_end"))
        chosen = F.when(ok, size) if chosen is None else chosen.when(ok, size)
    chosen = chosen.otherwise(F.least(F.lit(max_rows), F.col("_end")))
    g = g.select(*keys, "_end", chosen.alias("_size"))
    j = x.drop("_end").join(g, keys, "left")
    anchored = (F.col("_end").isNotNull() & (F.col("_pos") <= F.col("_end"))
                & (F.col("_pos") > F.col("_end") - F.col("_size")))
    no_signal = F.col("_end").isNull() & (F.col("_pos") > F.col("_tot") - max_rows)
    return j.where(anchored | no_signal).drop("_pos", "_end", "_tot", "_back", "_size")


def training_slice(df: DataFrame, k=None, ds: str = DS, q: str = Q, min_rows: int = 200,
                   recent_rows: int | None = None) -> DataFrame:
    """Per series, the non-zero rows when there are at least min_rows of
    them; else the last ``recent_rows`` rows (by default all) when they vary
    and number at least min_rows; else all rows."""
    keys = list(K if k is None else k)
    val = F.coalesce(F.col(q), F.lit(0.0))
    part = W.partitionBy(*keys)
    x = (df.withColumn("_nz", F.count_if(val > 0).over(part))
           .withColumn("_rd", F.row_number().over(_rev(k, ds))))
    recent = F.col("_rd") <= (recent_rows or 2 ** 31 - 1)
    x = (x.withColumn("_rsd", F.stddev_samp(F.when(recent, val)).over(part))
          .withColumn("_rn", F.count_if(recent).over(part)))
    use_nz = F.col("_nz") >= min_rows
    use_recent = (F.coalesce(F.col("_rsd"), F.lit(0.0)) > 0) & (F.col("_rn") >= min_rows)
    keep = (F.when(use_nz, val > 0).when(use_recent, recent).otherwise(F.lit(True)))
    return x.where(keep).drop("_nz", "_rd", "_rsd", "_rn")
