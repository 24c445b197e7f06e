"""Sparse one-hot vectors, on-hand sums, and texts for a summary's bias."""

from pyspark.sql import functions as F

from ebbflow.operators import accuracy as ac
from ebbflow.operators import clean as cl
from ebbflow.operators import features as fe


def test_sparse_vectors_of_many_levels(spark):
    n = 100_000
    df = spark.range(n).select("id", F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("c")).repartition(8)
    df = df.unionByName(spark.createDataFrame([(-1, None)], "id long, c string"))
    out, maps = cl.one_hot_sparse(df, ["c"])
    assert maps["c"].count() == n and out.columns == ["id", "c_onehot"]
    rows = {r["id"]: r["c_onehot"] for r in out.where("id in (-1, 0, 1, 2, 99999)").collect()}
    assert all(v.size == n - 1 for v in rows.values())
    assert rows[-1].indices.tolist() == [] and rows[0].indices.tolist() == []           # null, first level
    assert {i: rows[i].indices.tolist() for i in (1, 2, 99999)} == {i: [n - 1 - i] for i in (1, 2, 99999)}


def test_sparse_vectors_agree_with_columns(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "b")], "id int, c string")
    wide = {r["id"]: (r["c_b"], r["c_c"]) for r in cl.one_hot(df, ["c"], levels={"c": ["a", "b", "c"]}).collect()}
    sparse, _ = cl.one_hot_sparse(df, ["c"])
    assert {r["id"]: tuple(int(x) for x in r["c_onehot"].toArray()[::-1]) for r in sparse.collect()} == wide


def test_sparse_vectors_of_one_level_and_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, c string")
    for x in (df, df.where("c is null"), df.where("false")):
        out, _ = cl.one_hot_sparse(x, ["c"])
        assert all(r["c_onehot"].numNonzeros() == 0 for r in out.collect())


def test_on_hand_is_the_sum_of_what_is_there(spark):
    df = spark.createDataFrame([(1.0, None, 5), (None, None, None)], "customer_inventory_qty double, warehouse_inventory_qty double, current_inventory_units int")
    assert [r["on_hand_qty"] for r in fe.on_hand(df).collect()] == [6.0, 0.0]
    assert [r["on_hand_qty"] for r in fe.on_hand(df.select("warehouse_inventory_qty")).collect()] == [0.0, 0.0]
    assert fe.on_hand(spark.range(1)).first()["on_hand_qty"] == 0.0
    assert fe.on_hand(spark.range(1).withColumn("on_hand_qty", F.lit(7)).withColumn("warehouse_inventory_qty", F.lit(1))).first()["on_hand_qty"] == 7


def test_texts_of_a_summary(spark):
    df = spark.createDataFrame([(0.0, 10.0), (16.0, 31.0), (-16.0, 30.0), (6.0, None), (-6.0, 40.0), (None, 1.0)], "bias_percentage double, mape double")
    got = [r["recommendations"] for r in ac.bias_recommendations(df).collect()]
    assert [g.split(" ")[0] for g in got] == ["Bias", "Significant", "Significant", "Moderate", "Moderate", "Bias"]
    assert ["High forecast error" in g for g in got] == [False, True, False, False, True, False]
    assert "over" in got[1] and "under" in got[2] and "over" in got[3] and "under" in got[4]


def test_merged_sketches_count_about_right(spark):
    from ebbflow.operators import cube
    df = spark.range(60_000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 9001).alias("x"), (F.col("id") % 11).alias("y"))
    fine = cube.distinct_sketches(df, ["a", "b"], ["x", "y"])
    assert fine.count() == 21
    got = {r["a"]: (r["x"], r["y"]) for r in cube.merged_distinct(fine, ["a"], ["x", "y"]).collect()}
    exact = {r["a"]: (r["x"], r["y"]) for r in df.groupBy("a").agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).collect()}
    assert got.keys() == exact.keys()
    assert all(abs(got[a][0] - exact[a][0]) <= 0.05 * exact[a][0] and got[a][1] == 11 for a in exact)


def test_drill_options_read_the_table_once(spark):
    from ebbflow.operators import cube
    from ebbflow.sources import fixtures as fx
    out = cube.drill_options(fx.demand_history(spark, "/root/testdata/sf0.001"), "brand_day")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    assert out.count() == 4 and out.where("distinct_values > 0 and row_estimate > 0").count() == 4
