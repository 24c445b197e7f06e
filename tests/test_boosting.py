"""Boosted counts, and the rows that the scenario model learns from."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbflow.operators import boosting as bo
from ebbflow.operators import features as fe
from ebbflow.operators import models as md
from ebbflow.operators import scenario as sc

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def counts(spark):
    """Poisson counts whose mean depends on two features together: no log-linear model has it."""
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (6000, 3))
    mean = np.where(x[:, 0] * x[:, 1] > 0, 20.0, 2.0) * np.exp(0.3 * x[:, 2])
    rows = [(*map(float, r), float(y), "train" if i < 4500 else "test") for i, (r, y) in enumerate(zip(x, rng.poisson(mean)))]
    return spark.createDataFrame(rows, "a double, b double, c double, label double, split string").repartition(4).cache()


@pytest.fixture(scope="module")
def booster(counts):
    return bo.train_boosted_counts(counts.where("split = 'train'"), FEATURES, rounds=25, rate=0.3, depth=4)


def test_boosting_beats_the_log_linear_model(counts, booster):
    glm = md.train_counts(counts.where("split = 'train'"), FEATURES)
    p = booster.transform(md.predict(glm, counts), "boosted")
    errors = {c: {r["split"]: r["mae"] for r in md.evaluate_predictions(p, c).collect()} for c in ("prediction", "boosted")}
    assert errors["boosted"]["test"] < 0.6 * errors["prediction"]["test"]
    loss = {c: p.where("split = 'test'").agg(bo.poisson_loss(F.col("label"), F.greatest(c, F.lit(1e-9)))).first()[0] for c in ("prediction", "boosted")}
    assert loss["boosted"] < loss["prediction"]


def test_margins_are_the_sum_of_the_trees(counts, booster):
    rows = bo.assembler(FEATURES).transform(counts.limit(50)).collect()
    got = {tuple(r["_features"]): r["p"] for r in booster.transform(counts.limit(50), "p").withColumn("_features", F.array(*FEATURES)).collect()}
    for r in rows:
        margin = booster.base + booster.rate * sum(t.predict(r["_features"]) for t in booster.trees)
        assert math.isclose(got[tuple(r["_features"].toArray())], math.exp(margin), rel_tol=1e-9)


def test_early_stopping_drops_trees_after_the_best(spark):
    """Labels without any signal: the loss on held-out rows soon rises."""
    rng = np.random.default_rng(1)
    rows = [(*map(float, rng.uniform(size=3)), float(y)) for y in rng.poisson(5, 1500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double")
    model = bo.train_boosted_counts(df, FEATURES, rounds=40, rate=0.5, min_rows=5, patience=3)
    assert len(model.losses) < 40 and len(model.trees) == 1 + int(np.argmin(model.losses))
    assert len(model.losses) == len(model.trees) + 3


def test_saved_models_say_the_same(spark, counts, booster, tmp_path):
    booster.save(str(tmp_path / "m"))
    again = bo.CountBooster.load(spark, str(tmp_path / "m"))
    x = again.transform(booster.transform(counts, "p"), "q").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert x == 0 and again.features == FEATURES
    shares = booster.importances()
    assert abs(sum(shares) - 1) < 1e-6 and shares[2] < min(shares[:2])


def test_nothing_to_count(spark):
    schema = "a double, b double, c double, label double"
    for rows in ([], [(0.1, 0.2, 0.3, 0.0)] * 5):
        model = bo.train_boosted_counts(spark.createDataFrame(rows, schema), FEATURES)
        said = model.transform(spark.createDataFrame([(1.0, None, 2.0, 3.0)], schema)).first()["prediction"]
        assert model.trees == [] and 0 < said < 1e-8


def _series(spark, key, values):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([(key, "p", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)],
                                 "customer_id string, product_id string, ds date, order_qty double")


def test_block_ends_at_the_last_signal_and_must_vary(spark):
    """20 rows are allowed: the block of 20 has only two signals, that of 10 too; of a steady series none varies."""
    days = lambda df: sorted((r["ds"] - dt.date(2024, 1, 1)).days for r in df.collect())
    rich = _series(spark, "rich", [i % 4 for i in range(40)] + [0] * 6)                 # last signal at 39
    pick = lambda df, **more: days(fe.recent_signal_window(df, min_nonzero=6, blocks=(20, 10, 5), **more))
    assert pick(rich, max_rows=20) == list(range(20, 40))
    assert pick(rich) == list(range(40))
    assert pick(rich, max_rows=10) == list(range(30, 40))
    late = _series(spark, "late", [9] + [0] * 30 + [1, 2])
    assert pick(late, max_rows=20) == list(range(13, 33))                               # weak everywhere: the longest allowed
    assert pick(_series(spark, "none", [0] * 30), max_rows=20) == list(range(10, 30))


def test_training_rows_leave_out_series_that_do_not_vary(spark):
    some = _series(spark, "some", [i % 7 for i in range(30)] + [0] * 5)
    flat, none = _series(spark, "flat", [4] * 30), _series(spark, "none", [0] * 30)
    got = sc.training_rows(some.unionByName(flat).unionByName(none), ["customer_id", "product_id"], min_rows=10)
    rows = got.collect()
    assert {r["customer_id"] for r in rows} == {"some"}
    assert sorted(r["ds"].day for r in rows if r["ds"].month == 1) == [i + 1 for i in range(30) if i % 7] and all(r["order_qty"] > 0 for r in rows)
