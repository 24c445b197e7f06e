"""Forecast accuracy and bias tracking.

All metrics are grouped aggregates (partial aggregation, one shuffle on the
group key); texts are built with SQL string functions from the aggregates.
Error rules follow the reference: 0/0 counts as a perfect point, x/0 is left
out of MAPE, an empty MAPE is undefined (null here, infinity there).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import grade, r6, round_to

EPS_SK = 2.220446049250313e-16   # machine epsilon, the floor of a MAPE denominator


def point_errors(df: DataFrame, actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """Absolute, percentage (null when actual = 0 and forecast != 0),
    signed and squared error per row; all 0 when both are 0."""
    a, f = F.col(actual), F.col(forecast)
    err = f - a
    ape = F.when(a != 0, F.abs(err) / F.abs(a) * 100).when(f == 0, F.lit(0.0))
    return df.withColumns({"absolute_error": F.abs(err), "absolute_percentage_error": ape,
                           "bias": err, "squared_error": err * err})


def error_summary(df: DataFrame, k: Sequence[str], actual: str = "actual",
                  forecast: str = "forecast") -> DataFrame:
    """MAE, MAPE, bias, bias %, RMSE and points per group."""
    x = point_errors(df, actual, forecast)
    g = x.groupBy(*k).agg(
        F.avg("absolute_error").alias("_mae"), F.avg("absolute_percentage_error").alias("_mape"),
        F.avg("bias").alias("_bias"), F.sum("bias").alias("_sb"), F.sum(actual).alias("_sa"),
        F.sqrt(F.avg("squared_error")).alias("_rmse"), F.count(F.lit(1)).alias("data_points"))
    bias_pct = F.when(F.col("_sa") > 0, F.col("_sb") / F.col("_sa") * 100).otherwise(F.lit(0.0))
    return g.select(*k, r6("_mae").alias("mae"), r6("_mape").alias("mape"), r6("_bias").alias("bias"),
                    r6(bias_pct).alias("bias_percentage"), r6("_rmse").alias("rmse"), "data_points")


def accuracy_grade(summary: DataFrame, mape: str = "mape") -> DataFrame:
    """I03."""
    return summary.withColumn("accuracy_grade", grade(mape))


def bias_class(summary: DataFrame, pct: str = "bias_percentage") -> DataFrame:
    """Direction beyond +-5 %, severity medium > 8, high > 15."""
    b = F.col(pct)
    direction = F.when(F.abs(b) > 5, F.when(b > 0, "over_forecasting").otherwise("under_forecasting")) \
                 .otherwise("neutral")
    severity = F.when(F.abs(b) > 15, "high").when(F.abs(b) > 8, "medium").otherwise("low")
    return summary.withColumns({"bias_direction": direction, "bias_severity": severity})


def _version_message(v: Column, b: Column) -> Column:
    return (F.when(F.abs(b) <= 5, F.concat(v, F.lit(": Bias within acceptable range")))
             .when(b > 15, F.concat(v, F.lit(": High over-forecasting")))
             .when(b < -15, F.concat(v, F.lit(": High under-forecasting")))
             .otherwise(F.concat(v, F.lit(": No recommendations"))))


def bias_messages(summary: DataFrame, version: str = "forecast_version_name") -> DataFrame:
    """One recommendation per version plus the overall list (high-bias
    versions, majority direction, least-biased version under 5 %), joined
    with ' | '."""
    c = bias_class(summary)
    per = c.select(version, _version_message(F.col(version), F.col("bias_percentage")).alias("message"))
    o = c.agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("bias_severity") == "high", F.col(version)))),
                     ", ").alias("_high"),
        F.count_if(F.col("bias_direction") == "over_forecasting").alias("_over"),
        F.count_if(F.col("bias_direction") == "under_forecasting").alias("_under"),
        F.min_by(F.struct(F.col(version), F.col("bias_percentage")),
                 F.struct(F.abs("bias_percentage"), F.col(version))).alias("_best"))
    # The texts.
    msgs = F.array(
        F.when(F.col("_high") != "", F.concat(F.lit("High bias detected in models: "), F.col("_high"),
                                              F.lit(". Consider model recalibration."))),
        F.when(F.col("_over") > F.col("_under"),
               F.lit("Systematic over-forecasting detected across multiple models. "
                     "Consider reducing baseline forecasts."))
         .when(F.col("_under") > F.col("_over"),
               F.lit("Systematic under-forecasting detected across multiple models. "
                     "Consider increasing baseline forecasts.")),
        F.when(F.abs(F.col("_best.bias_percentage")) < 5,
               F.concat(F.lit("Model '"), F.col(f"_best.{version}"), F.lit("' shows minimal bias ("),
                        round_to(F.col("_best.bias_percentage"), 1).cast("string"),
                        F.lit("%) - consider as primary model."))))
    joined = F.array_join(F.filter(msgs, lambda m: m.isNotNull()), " | ")
    overall = o.select(F.lit("overall").alias(version),
                       F.when(joined == "", F.lit("Bias levels are within acceptable ranges across all models."))
                        .otherwise(joined).alias("message"))
    return per.unionByName(overall)


def bias_recommendations(summary: DataFrame, pct: str = "bias_percentage", mape: str = "mape") -> DataFrame:
    """I05 for one summary a row: the text for its bias, and a second one where
    the error is high, joined with ' | '."""
    b = F.coalesce(F.col(pct), F.lit(0.0))
    # The texts.
    by_bias = (F.when(F.abs(b) <= 5, "Bias is within acceptable range (±5%)")
                .when(b > 15, "Significant over-forecasting detected. Consider reducing forecast levels.")
                .when(b < -15, "Significant under-forecasting detected. Consider increasing forecast levels.")
                .when(b > 5, "Moderate over-forecasting. Monitor and adjust if trend continues.")
                .otherwise("Moderate under-forecasting. Monitor and adjust if trend continues."))
    by_error = F.when(F.col(mape) > 30, "High forecast error detected. Consider model recalibration or alternative methods.")
    return summary.withColumn("recommendations", F.concat_ws(" | ", by_bias, by_error))


def overall_bias(summary: DataFrame) -> DataFrame:
    """Predominantly over / under / mixed across versions; number of
    versions whose severity is not low."""
    c = bias_class(summary)
    over = F.count_if(F.col("bias_direction") == "over_forecasting")
    under = F.count_if(F.col("bias_direction") == "under_forecasting")
    return c.agg(
        F.when(F.count(F.lit(1)) == 0, "neutral").when(over > under, "predominantly_over_forecasting")
         .when(under > over, "predominantly_under_forecasting").otherwise("mixed_bias_patterns")
         .alias("overall_bias_direction"),
        F.count(F.lit(1)).alias("version_count"),
        F.count_if(F.col("bias_severity") != "low").alias("consistent_bias_versions"),
        F.sum("data_points").alias("total_data_points"))


def bias_consistency(bt: DataFrame, k: Sequence[str], ds: str, actual: str = "actual",
                     forecast: str = "forecast", min_rows: int = 8) -> DataFrame:
    """Per group with more than 7 rows: 7-row rolling mean bias (min 3),
    correlation of bias with time order, its direction at +-0.1, bias std and
    the number of periods whose rolling bias exceeds 10 in size."""
    keys = list(k)
    w = W.partitionBy(*keys).orderBy(ds)
    f7 = w.rowsBetween(-6, 0)
    x = (point_errors(bt, actual, forecast)
         .withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
         .withColumn("_roll", F.when(F.count("bias").over(f7) >= 3, F.avg("bias").over(f7))))
    g = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.corr("bias", "_i").alias("_c"),
                             F.stddev_samp("bias").alias("_sd"),
                             F.count_if(F.abs("_roll") > 10).alias("consistent_bias_periods"))
    return g.where(F.col("_n") >= min_rows).select(
        *keys, r6("_c").alias("bias_trend_correlation"),
        F.when(F.col("_c") > 0.1, "increasing").when(F.col("_c") < -0.1, "decreasing")
         .otherwise("stable").alias("trend_direction"),
        r6("_sd").alias("bias_volatility"), "consistent_bias_periods")


def bias_by(bt: DataFrame, by: str, actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """Mean, std and count of the bias per value of ``by``, 2 places."""
    x = point_errors(bt, actual, forecast)
    return x.groupBy(by).agg(round_to(F.avg("bias"), 2).alias("avg_bias"),
                             round_to(F.stddev_samp("bias"), 2).alias("bias_volatility"),
                             F.count("bias").alias("data_points"))


def regression_metrics(df: DataFrame, y: str, yhat: str, split: str | None = "split") -> DataFrame:
    """MAE, RMSE, R2, SMAPE (0..2, 0/0 -> 0), MAPE (denominator floored at
    machine epsilon), variance ratio and means -- one aggregate pass per split
    (SST from ``var_pop``)."""
    yt, yp = F.col(y), F.col(yhat)
    err = yp - yt
    den = F.abs(yt) + F.abs(yp)
    keys = [split] if split else []
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("_mae"), F.avg(err * err).alias("_mse"),
        F.var_pop(yt).alias("_vy"), F.var_pop(yp).alias("_vp"),
        F.avg(2.0 * F.abs(err) / F.when(den == 0, F.lit(1.0)).otherwise(den)).alias("_smape"),
        F.avg(F.abs(err) / F.greatest(F.abs(yt), F.lit(EPS_SK))).alias("_mape"),
        F.avg(yt).alias("_my"), F.avg(yp).alias("_mp"))
    r2 = F.when(F.col("_vy") > 0, 1 - F.col("_mse") / F.col("_vy")) \
          .otherwise(F.when(F.col("_mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return g.select(*keys, "n", r6("_mae").alias("mae"), r6(F.sqrt("_mse")).alias("rmse"),
                    r6(r2).alias("r2"), r6("_smape").alias("smape"), r6(F.col("_mape") * 100).alias("mape"),
                    r6(F.when(F.col("_vy") > 0, F.col("_vp") / F.col("_vy")).otherwise(F.lit(0.0)))
                    .alias("explained_variance"),
                    r6("_my").alias("mean_actual"), r6("_mp").alias("mean_predicted"))


def smape_leaderboard(df: DataFrame, by: str, y: str, yhat: str, n: int = 20,
                      min_rows: int = 10) -> DataFrame:
    """SMAPE and rows per group; the best n and the worst n (worst
    first) among groups with at least ``min_rows`` rows.  Both lists are
    top-k (TakeOrdered), so no task ranks all groups."""
    yt, yp = F.col(y), F.col(yhat)
    den = F.abs(yt) + F.abs(yp)
    s = df.groupBy(by).agg(
        F.avg(2.0 * F.abs(yp - yt) / F.when(den == 0, F.lit(1.0)).otherwise(den)).alias("smape"),
        F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_rows)
    s = s.withColumn("smape", r6("smape"))
    best = s.orderBy("smape", by).limit(n)
    worst = s.orderBy(F.desc("smape"), F.desc(by)).limit(n)
    best = best.withColumn("rank", F.row_number().over(W.orderBy("smape", by))) \
               .withColumn("list", F.lit("best"))
    worst = worst.withColumn("rank", F.row_number().over(W.orderBy(F.desc("smape"), F.desc(by)))) \
                 .withColumn("list", F.lit("worst"))
    return best.unionByName(worst)
