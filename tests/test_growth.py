"""Work that must not grow faster than the input: what a plan reads, shuffles and broadcasts."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from ebbflow.functions import columns as fc
from ebbflow.operators import boosting as bo
from ebbflow.operators import cube
from ebbflow.operators import joins as jn
from ebbflow.operators import quality as qa
from ebbflow.plans import load_all, written_series
from ebbflow.sources import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def line_scans(df) -> int:
    return plan(df).count("lineitem.parquet")


def test_days_of_promotions_are_not_broadcast(spark):
    day = dt.date(2024, 1, 1)
    dates = spark.createDataFrame([("a", day + dt.timedelta(days=i)) for i in range(5)], "product_id string, ds date")
    promo = spark.createDataFrame([(1, "A ", day, day + dt.timedelta(days=2), 5.0), (2, "a", day + dt.timedelta(days=1), day, 5.0)],
                                  "promo_id int, product_id string, start_date date, end_date date, discount double")
    out = jn.active_promotions(dates, promo)
    assert "Broadcast" not in plan(out) and "SortMergeJoin" in plan(out)
    assert sorted(r["ds"].day for r in out.select(dates["ds"]).collect()) == [1, 2, 3]


def test_repeats_of_dirty_rows_join_once(spark):
    d = fx.dirty_history(spark, SF_SMALL)
    assert line_scans(d) == 1
    h = fx.demand_history(spark, SF_SMALL)
    again = h.where((F.col("order_id").cast("long") * 7 + F.col("line_number")) % 50 == 13).count()
    assert again > 0 and d.count() == h.count() + again


def test_profile_reads_the_table_twice(spark):
    assert line_scans(load_all()["table_profile"][0](spark, SF_SMALL)) <= 2
    assert line_scans(load_all()["total_drift"][0](spark, SF_SMALL)) <= 2
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (None, "y"), (None, "y"), (2, None)], "a int, b string")
    for approx in (False, True):
        got = {r["column_name"]: tuple(r)[2:] for r in qa.table_profile(df, approx).collect()}
        assert got == {"a": (2, 2, 6, 3), "b": (1, 2, 6, 3)}


def test_date_forms_are_tried_on_text_of_their_shape(spark):
    texts = ["2024-01-05", "1/5/2024", " 1/5/2024 ", "1/5/2024 22:56", "01/05/2024 2:06:07", "1-5-2024", "2024/1/5", "13/1/2024", "1/5/24",
             "+1/5/2024", "1/5/+12024", "1/5/2024 X", "P12", "NATION_3", "not a date", "", "1/5/2024\n", "١/5/2024", "2024-01-05T01:02:03", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    text = F.trim("t")
    plain = F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in fc.DATE_FORMATS])
    rows = df.select("t", fc.parse_timestamp("t").cast("string").alias("got"), plain.cast("string").alias("want")).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows] and sum(r["got"] is not None for r in rows) >= 7
    assert plan(df.select(fc.parse_timestamp("t"))).count("RLIKE") >= len(fc.DATE_FORMATS)
    month = spark.createDataFrame([("5 Jan 2024",)], "t string").select(fc.parse_timestamp("t", ("d MMM yyyy",)).alias("d")).first()["d"]
    assert month == dt.datetime(2024, 1, 5)


def test_levels_share_one_shuffle_by_sku(spark):
    day = dt.date(2024, 1, 1)
    rows = [(f"B{i % 2}", f"S{i % 5}" if i % 7 else None, f"L{i % 3}", f"C{i % 2}", day + dt.timedelta(days=i % 4), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "brand string, sku_id string, location string, channel string, order_date date, total_demand_qty double")
    out = cube.rollup_all(df)
    assert plan(out).count("ENSURE_REQUIREMENTS") == 1      # the coarse levels'
    assert out.columns == ["brand", "sku_id", "location", "channel", "order_date", "total_demand_qty", "record_count", "level"]
    key = lambda r: tuple(str(v) for v in r)
    for lv, dims in cube.LEVELS.items():
        names = [*dims, "order_date", "total_demand_qty", "record_count"]
        got = out.where(F.col("level") == lv)
        assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, cube.rollup(df, lv).select(*names).collect()))
        assert got.where(" or ".join(f"{c} is not null" for c in cube.ALL_DIMS if c not in dims) or "false").count() == 0


def test_reviews_read_the_history_once_for_each_purpose(spark):
    assert line_scans(load_all()["validate_combinations"][0](spark, SF_SMALL)) == 1     # the values are written before
    assert line_scans(load_all()["adjustment_review_by_place"][0](spark, SF_SMALL)) == 0


def test_models_read_written_series(spark):
    daily = written_series(spark, SF_SMALL)
    assert line_scans(daily) == 0 and written_series(spark, SF_SMALL) is daily
    assert daily.exceptAll(fx.daily_series(spark, SF_SMALL)).count() == 0
    for name in ("score_range_rows", "scenario_model_forecast"):
        assert line_scans(load_all()[name][0](spark, SF_SMALL)) == 0


def test_a_round_evaluates_only_new_trees(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (800, 2))
    df = spark.createDataFrame([(*map(float, r), float(y)) for r, y in zip(x, rng.poisson(np.exp(1 + 2 * x[:, 0] * x[:, 1])))], "a double, b double, label double")
    seen, sums = [], bo.CountBooster.sums

    def counted(self, df, name, carried=None, since=0):
        seen.append(len(self.trees) - since)
        return sums(self, df, name, carried, since)
    monkeypatch.setattr(bo, "WRITE_EVERY", 3)
    monkeypatch.setattr(bo.CountBooster, "sums", counted)
    model = bo.train_boosted_counts(df, ["a", "b"], rounds=8, min_rows=20, patience=8, depth=3)
    assert max(seen) <= 4 and len(model.losses) == 8
    whole = bo.train_boosted_counts(df, ["a", "b"], rounds=1, min_rows=20, depth=3)
    assert math.isclose(whole.losses[0], model.losses[0], rel_tol=1e-12)
    monkeypatch.setattr(bo, "WRITE_EVERY", 100)
    again = bo.train_boosted_counts(df, ["a", "b"], rounds=8, min_rows=20, patience=8, depth=3)
    assert again.losses == model.losses
