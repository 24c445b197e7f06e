"""Train/test splits, feature matrices and MLlib models.

Learners are MLlib's (distributed): gradient-boosted trees for revenue and
scenario models; for order counts a Poisson GLM and boosted trees with
Poisson loss (``boosting``: MLlib's trees have none).  Splits are computed without a global row sort: the
chronological split ranks *distinct dates* (bounded by the calendar), the
positional split ranks *distinct keys* by cumulative counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as fc
from ..session import cut_lineage
from . import clean, features as fe

K = ["customer_id", "product_id"]
DS = "ds"
Q = "order_qty"
# Columns describing the same day as the target (leak guard).
SAME_DAY_COLUMNS = ("order_qty", "revenue", "base_demand_qty", "promotional_demand_qty",
                    "total_demand_qty", "n_lines", "price", "discount_percent")
# Features of the count model.
COUNT_FEATURES = ["order_year", "order_month", "order_day", "order_day_of_week", "quarter",
                  "is_month_start", "is_month_end", "is_weekend",
                  "qty_lag_1", "qty_lag_7", "revenue_lag_1", "revenue_lag_7",
                  "discount_percent_lag_1", "price_lag_1",
                  "qty_rolling_mean_7_past", "qty_rolling_std_7_past",
                  "revenue_rolling_mean_7_past", "revenue_rolling_std_7_past",
                  "qty_roll14", "days_since_pos_order", "zero_streak", "zero_share_28",
                  "qty_trend_14", "qty_cv_28", "price_ratio_28", "prev_spike_7",
                  "is_promo_day", "disc_pct"]


# ------------------------------------------------------------------ splits

def split_chronological(df: DataFrame, ds: str = DS, test_ratio: float = 0.2, gap_days: int = 7,
                        min_dates: int = 10, keys: Sequence[str] = K) -> DataFrame:
    """Split on the date at position int(D * 0.8) of the D distinct dates,
    with a gap of ``gap_days`` before it (rows inside the gap are dropped);
    without the gap when a side would be empty; by position (date, then
    keys) when fewer than ``min_dates`` dates exist.  Adds ``split``.

    One aggregate gives the row count per distinct date -- a table bounded by
    the calendar, not by the data -- from which the split date and the cut
    are chosen; they enter the final filter as literals (so a scan of a
    date-partitioned table prunes partitions)."""
    day = F.col(ds).cast("date")        # a calendar's worth of rows also for timestamps
    per_date = sorted((r[0], r[1]) for r in
                      df.where(F.col(ds).isNotNull()).groupBy(day.alias("_day")).count().collect())
    n_dates = len(per_date)
    if n_dates < min_dates:
        order = [ds] + [c for c in keys if c in df.columns]
        x = _positional_labels(df, order, 1 - test_ratio, keys=order)
        return x.withColumnRenamed("_pos_split", "split")
    ix = max(1, min(int(n_dates * (1 - test_ratio)), n_dates - 1))
    split_date = per_date[ix][0]
    import datetime as _dt
    train_end = split_date - _dt.timedelta(days=gap_days)
    n_train_gap = sum(c for d, c in per_date if d < train_end)
    n_test = sum(c for d, c in per_date if d >= split_date)
    cut = split_date if (n_train_gap == 0 or n_test == 0) else train_end
    by_date = (F.when(day < F.lit(cut), F.lit("train"))
                .when(day >= F.lit(split_date), F.lit("test")))
    return df.withColumn("split", by_date).where(F.col("split").isNotNull())


def _positional_labels(df: DataFrame, order: Sequence[str], ratio: float, keys: Sequence[str] = ()) -> DataFrame:
    """'train' for the first int(n * ratio) rows in ``order``, else 'test'.

    Rows are numbered without a global sort: cumulative counts over the
    distinct key blocks (one row per block, summed range by range) give each
    block its offset, a per-block ``row_number`` gives the position inside it."""
    lead = list(keys) or [order[0]]
    rest = [c for c in order if c not in lead]
    n = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(*lead).agg(F.count(F.lit(1)).alias("_c"))
    # offsets: running total over the distinct leading keys (one row per key
    # block), computed range by range -- no single-task window
    offs = clean.running_offsets(counts, lead, "_c")
    o = offs.select(*[F.col(c).alias(f"_k_{c}") for c in lead], "_off")
    x = df.join(o, [df[c].eqNullSafe(o[f"_k_{c}"]) for c in lead]).drop(*[f"_k_{c}" for c in lead])
    w = W.partitionBy(*lead).orderBy(*(rest or lead))
    pos = F.col("_off") + F.row_number().over(w)
    return x.withColumn("_pos_split", F.when(pos <= F.floor(n * ratio), "train").otherwise("test")) \
            .drop("_off")


def split_fraction(df: DataFrame, order: Sequence[str] = ("customer_id", "product_id", DS),
                   ratio: float = 0.8) -> DataFrame:
    """First 80 % of rows in (customer, product, date) order -- the
    reference's positional split, which therefore splits by customer."""
    order = list(order)
    # blocks are whole order keys: a row's window only holds its exact ties,
    # however many rows one (customer, product) pair has
    x = _positional_labels(df, order, ratio, keys=order)
    return x.withColumnRenamed("_pos_split", "split")


def split_quantile(df: DataFrame, ds: str = DS, p: float = 0.8) -> DataFrame:
    """train = rows up to the p-quantile of the date (linear)."""
    q = df.agg(F.percentile(F.unix_date(F.col(ds)), p)).scalar()
    return df.withColumn("split", F.when(F.unix_date(F.col(ds)) <= q, "train").otherwise("test"))


# ------------------------------------------------------------------ feature matrix

def training_frame(daily: DataFrame, promo: DataFrame | None = None, k=None, ds: str = DS,
                   q: str = Q) -> DataFrame:
    """Calendar + E01-E14 (past-only windows) + promotion flags per row."""
    x = clean.calendar_features(daily, ds)
    x = fe.window_features(x, k, ds, q)
    if promo is not None:
        from .joins import promo_join
        x = promo_join(x, promo, ds=ds)
    return x


def feature_matrix(df: DataFrame, features: Sequence[str], target: str = Q,
                   fit: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The listed features (missing ones -> 0), target = max(q, 0), nulls
    filled with medians of ``fit`` (the training rows); refuses same-day
    columns that would leak the target."""
    leaky = [c for c in features if c in SAME_DAY_COLUMNS]
    if leaky:
        raise ValueError(f"same-day columns leak the target: {leaky}")
    present = [c for c in features if c in df.columns]
    x = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in present],
                  *[F.lit(0.0).alias(c) for c in features if c not in df.columns],
                  F.greatest(F.coalesce(F.col(target).cast("double"), F.lit(0.0)), F.lit(0.0))
                  .alias("label"))
    src = fit.select(*[F.col(c).cast("double").alias(c) for c in present]) if fit is not None else x
    return clean.impute_median(x, present, fit=src, approx=False)


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def train_counts(train: DataFrame, features: Sequence[str], max_iter: int = 50) -> PipelineModel:
    """Order counts with a Poisson GLM (log link)."""
    glm = GeneralizedLinearRegression(family="poisson", link="log", maxIter=max_iter, regParam=0.01,
                                      labelCol="label", featuresCol="features")
    # IRLS re-reads the training rows every iteration: materialise them once
    # (reliable checkpoint, so the long window-feature lineage is cut)
    return Pipeline(stages=[_assembler(features), glm]).fit(cut_lineage(train))


def train_gbt(train: DataFrame, features: Sequence[str], label: str = "label", max_iter: int = 30,
              max_depth: int = 5, seed: int = 42, validation_percent: int = 10) -> PipelineModel:
    """Gradient-boosted regression trees with early stopping: trees
    are added until they no longer help on ``validation_percent`` of the
    training rows (chosen by a hash of their features), at most ``max_iter``."""
    gbt = GBTRegressor(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth,
                       seed=seed, subsamplingRate=0.8, stepSize=0.1)
    if validation_percent:
        train = train.withColumn("_held", F.pmod(F.xxhash64(*features), F.lit(100)) < validation_percent)
        gbt = gbt.setValidationIndicatorCol("_held")
    return Pipeline(stages=[_assembler(features), gbt]).fit(cut_lineage(train))


def predict(model: PipelineModel, df: DataFrame, clip: bool = True) -> DataFrame:
    out = model.transform(df).drop("features")
    if clip:
        out = out.withColumn("prediction", F.greatest(F.col("prediction"), F.lit(0.0)))
    return out


def evaluate(model: PipelineModel, mat: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """``evaluate_predictions`` of a fitted model's predictions."""
    return evaluate_predictions(predict(model, mat), "prediction", label, split)


def evaluate_predictions(df: DataFrame, prediction: str, label: str = "label", split: str = "split") -> DataFrame:
    """Per split: rows, label total, the predictions' mean error (``mae``) and
    that of always saying the training rows' mean (``naive_mae``).  Scoring is
    one distributed pass; the total is exact to six places in any order."""
    naive = df.where(F.col(split) == "train").agg(F.avg(label).alias("_naive_mean"))
    p = clean.beside(df, naive)
    g = p.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("decimal(38,6)")).cast("double").alias("label_sum"),
                             F.avg(F.abs(F.col(label) - F.col("_naive_mean"))).alias("_naive"),
                             F.avg(F.abs(F.col(label) - F.col(prediction))).alias("_mae"))
    return g.select(split, "n", "label_sum", F.col("_mae").alias("mae"), F.col("_naive").alias("naive_mae"))


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Features ranked by the tree ensemble's importance (GBT), or by the
    absolute GLM coefficient."""
    m = model.stages[-1]
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in m.coefficients.toArray().tolist()]
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    rows = sorted(zip(features, vals), key=lambda t: (-t[1], t[0]))
    return s.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                             "feature string, importance double, rank int")


# ------------------------------------------------------------------ scoring the future

def future_features(hist: DataFrame, start, end, k=None, ds: str = DS, q: str = Q,
                    days_recent: int = 28) -> DataFrame:
    """Feature rows for every recent series x every day of [start, end],
    built from the observed tail of each series (E20) plus calendar
    features -- future rows never see imputed future quantities."""
    from .joins import future_grid
    keys = list(K if k is None else k)
    combos = fe.recent_combos(hist, days_recent, keys, ds)
    grid = future_grid(combos, start, end, ds)
    tail = fe.tail_features(hist, keys, ds, q)
    x = grid.join(tail, keys, "left")
    return clean.calendar_features(x, ds)


def score_range(model: PipelineModel, hist: DataFrame, start, end, features: Sequence[str],
                k=None, ds: str = DS, q: str = Q, max_days: int = 180,
                customers: Sequence[str] | None = None, products: Sequence[str] | None = None) -> DataFrame:
    """Predictions for every recent series over [start, end], optional
    customer / product lists, clipped at 0, sorted by date then keys.  A range
    of more than ``max_days`` days is refused, never shortened."""
    keys = list(K if k is None else k)
    s = F.lit(start).cast("date") if isinstance(start, str) else start
    e = F.lit(end).cast("date") if isinstance(end, str) else end
    too_long = F.raise_error(F.lit(f"the date range is longer than {max_days} days"))
    e = F.when(F.date_diff(e, s) < max_days, e).otherwise(too_long.cast("date"))
    fut = future_features(hist, s, e, keys, ds, q)
    if customers:
        fut = fut.where(fc.norm_text(keys[0]).isin([c.strip().lower() for c in customers]))
    if products:
        fut = fut.where(fc.norm_text(keys[1]).isin([p.strip().lower() for p in products]))
    mat = fut.select(*keys, ds, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                  if c in fut.columns else F.lit(0.0).alias(c) for c in features])
    out = predict(model, mat).select(*keys, ds, F.col("prediction").alias("pred_order_qty"))
    return out.orderBy(ds, *keys)
