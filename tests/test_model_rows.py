"""Rows of the model queries: values, not only flags."""

import pytest
from pyspark.sql import functions as F

from ebbflow.plans import load_all

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["count_model", "revenue_model", "scenario_model"])
def test_predictions_of_both_splits(spark, name):
    """Per-row predictions beat the training mean on the rows learned from, so a model that says 0 fails."""
    x = load_all()[f"{name}_rows"][0](spark, SF_SMALL).cache()
    digest = {r["split"]: r["n"] for r in load_all()[name][0](spark, SF_SMALL).groupBy("split").agg(F.sum("n").alias("n")).collect()}
    got = {r["split"]: r for r in x.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("prediction").alias("least"), F.count("prediction").alias("p"),
                                                        F.countDistinct("prediction").alias("values")).collect()}
    assert {s: r["n"] for s, r in got.items() if s} == {s: n for s, n in digest.items() if s} and set(digest) >= {"train", "test"}
    assert all(r["p"] == r["n"] and r["least"] >= 0 and r["values"] > 1 for r in got.values())
    train = x.where("split = 'train'")
    mean = train.agg(F.avg("label")).first()[0]
    error, naive = train.agg(F.avg(F.abs(F.col("label") - F.col("prediction"))), F.avg(F.abs(F.col("label") - mean))).first()
    assert error < naive


def test_counts_of_the_range(spark):
    x = load_all()["score_range_rows"][0](spark, SF_SMALL)
    assert x.columns == ["customer_id", "product_id", "ds", "pred_order_qty"]
    days, values, least = x.agg(F.countDistinct("ds"), F.countDistinct("pred_order_qty"), F.min("pred_order_qty")).first()
    assert days == 14 and values > 1 and least >= 0


def test_forecast_rows_have_values_and_bands(spark):
    x = load_all()["scenario_model_forecast_rows"][0](spark, SF_SMALL)
    rows = x.groupBy("scenario_id").agg(F.countDistinct("forecast").alias("values"), F.max("forecast").alias("top"), F.max(F.greatest(
        F.abs(F.col("upper") - 1.15 * F.col("forecast")), F.abs(F.col("lower") - 0.85 * F.col("forecast")))).alias("off")).collect()
    assert rows and all(r["values"] > 1 and r["top"] > 0 and r["off"] <= 0.5 for r in rows)       # whole numbers


def test_metrics_and_leaderboard_are_those_of_the_predictions(spark):
    """Recomputed in pandas from the rows of both learners."""
    import numpy as np
    rows = load_all()["count_model_rows"][0](spark, SF_SMALL).toPandas()
    got = {(r["learner"], r["split"]): r for r in load_all()["count_model_metrics"][0](spark, SF_SMALL).collect()}
    assert len(got) == 4
    for learner, column in (("glm", "prediction"), ("boosted", "boosted")):
        for split, x in rows.groupby("split"):
            e, y, p = x[column] - x["label"], x["label"], x[column]
            r = got[learner, split]
            smape = np.mean(2 * np.abs(e) / np.where(y.abs() + p.abs() == 0, 1, y.abs() + p.abs()))
            assert r["n"] == len(x) and abs(r["mae"] - e.abs().mean()) < 2e-6 and abs(r["rmse"] - np.sqrt((e ** 2).mean())) < 2e-6
            assert abs(r["r2"] - (1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 2e-6 and abs(r["smape"] - smape) < 2e-6
    board = load_all()["count_model_leaderboard"][0](spark, SF_SMALL).collect()
    test = rows[rows["split"] == "test"]
    each = {}
    for customer, x in test.groupby("customer_id"):
        if len(x) >= 10:
            each[customer] = np.mean(2 * (x["boosted"] - x["label"]).abs() / (x["boosted"].abs() + x["label"].abs()))
    best = [r["customer_id"] for r in sorted((r for r in board if r["list"] == "best"), key=lambda r: r["rank"])]
    assert best and set(best) <= set(each)
    for r in board:
        assert abs(r["smape"] - each[r["customer_id"]]) < 2e-6
    assert abs(each[best[0]] - min(each.values())) < 2e-6
