"""Adjustment review by SKU, channel and location: recommendations are those of the series that is named."""

import datetime as dt

from pyspark.sql import functions as F

from ebbflow.operators import adjust as aj


def test_recommendations_and_warnings_of_the_named_series(spark):
    first = dt.date(2024, 1, 1)         # a Monday; in the web shop of Lima Mondays sell ten times as much
    rows = []
    for i in range(70):
        day = first + dt.timedelta(days=i)
        rows.append(("P1", "web", "Lima", day, 100.0 if i % 7 == 0 else 10.0, False))
        rows.append(("P1", "shop", "Rome", day, 1000.0, False))
    hist = spark.createDataFrame(rows, "sku_id string, channel string, location string, order_date date, total_demand_qty double, is_promotional boolean")
    monday = dt.date(2024, 6, 3)
    asked = [(1, "P1", "web", "Lima"), (2, "P1", "web", None), (3, "P1", " ", ""), (4, "P1", "kiosk", "Lima"), (5, "P2", None, None), (6, "P1", "shop", "Lima")]
    adj = spark.createDataFrame([(i, s, c, p, monday, 50.0, "absolute", 60.0) for i, s, c, p in asked],
                                "adjustment_id int, sku_id string, channel string, location string, target_date date, current_value double, "
                                "adjustment_type string, adjustment_value double")
    master = spark.createDataFrame([("P1", "thing", "b")], "sku_id string, product_name string, brand string")
    promo = spark.createDataFrame([("b", monday, monday, 5.0)], "product_id string, start_date date, end_date date, discount double")
    got = {r["adjustment_id"]: r for r in aj.adjustment_review_by_place(adj, hist, master, promo).collect()}
    assert {i: (r["channel"], r["location"]) for i, r in got.items()} == {
        1: ("web", "Lima"), 2: ("web", "*"), 3: ("*", "*"), 4: ("kiosk", "Lima"), 5: ("*", "*"), 6: ("shop", "Lima")}
    assert [got[i]["historical_data_points"] for i in range(1, 7)] == [70, 70, 70, 0, 0, 0]
    assert "Day-of-week pattern: 100.0" in got[1]["recommendations"] and got[1]["recommendations"] == got[2]["recommendations"]
    web = hist.where("channel = 'web'").select("sku_id", F.col("order_date").alias("ds"), F.col("total_demand_qty").alias("order_qty"), "is_promotional")
    alone = aj.adjustment_advice(web, ["sku_id"], targets=adj.select("sku_id", "target_date")).first()
    assert got[1]["recommendations"] == alone["recommendations"]
    assert not got[3]["recommendations"] and got[4]["recommendations"] is None
    assert got[1]["system_forecast"] == 100.0 and got[3]["system_forecast"] == 1100.0 and got[4]["system_forecast"] is None
    assert got[1]["active_promotion"] and got[1]["warnings"] == ""
    assert got[4]["warnings"] == ("Channel kiosk not found in historical data|No historical data for exact combination: SKU=P1, Channel=kiosk, Location=Lima")
    assert got[5]["warnings"] == ("SKU P2 not found in historical data|No historical data for exact combination: SKU=P2, Channel=, Location=|"
                                  "SKU P2 not found in master catalog")
    assert got[6]["warnings"] == "No historical data for exact combination: SKU=P1, Channel=shop, Location=Lima"
