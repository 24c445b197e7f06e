"""File sources and sinks against temporary folders, and the streaming log."""

import json
import os

import pytest

from pyspark.sql import functions as F

from ebbflow.sources import readers as rd
from ebbflow.sources import sinks as sk
from ebbflow.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _write(path, text, enc):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=enc) as f:
        f.write(text)


def test_csv_encodings_and_folder_union(spark, tmp_path):
    root = str(tmp_path / "raw")
    _write(f"{root}/a.csv", "Order Id,order date (DateOrders),Sales,Order City\n1,2024-01-02,10.5,Zürich\n", "utf-8")
    _write(f"{root}/sub/b.csv", "order_id,date,revenue,city\n2,2024-01-03,7,Bogotá\n", "latin1")
    _write(f"{root}/sub/bad.csv", "x,y\n1,2\n", "utf-8")
    _write(f"{root}/empty.csv", "", "utf-8")
    enc = {os.path.basename(r.path): r.encoding for r in rd.detect_encodings(
        spark, rd.list_files(spark, root)).collect()}
    assert enc["a.csv"] == "utf-8" and enc["b.csv"] == "iso-8859-1" and enc["empty.csv"] is None
    df, skipped = rd.read_folder_union(spark, root)
    rows = sorted((r.order_id, r.city, r.revenue) for r in df.collect())
    assert rows == [("1", "Zürich", "10.5"), ("2", "Bogotá", "7")]
    assert len(df.columns) == 36     # 35 canonical + source_file lineage
    reasons = {os.path.basename(p): why for p, why in skipped}
    assert "empty.csv" in reasons and "bad.csv" in reasons


def test_reference_tables_prefer_cleaned(spark, tmp_path):
    root = str(tmp_path / "dims")
    _write(f"{root}/sku.csv", " sku_id ,created_date\nA,2024-01-01\n", "utf-8")
    _write(f"{root}/sku_clean.csv", "sku_id,created_date\nB,2024-02-01\n", "utf-8")
    _write(f"{root}/alerts.csv", "alert_id,alert_date\n7,not a date\n", "utf-8")
    t = rd.load_reference_tables(spark, root)
    assert [r.sku_id for r in t["sku"].collect()] == ["B"]
    assert t["alerts"].collect()[0].alert_date is None


def test_writers_roundtrip(spark, tmp_path):
    d = fx.daily_series(spark, SF)
    p = str(tmp_path / "t")
    sk.write_table(d.withColumn("month", F.date_format("ds", "yyyy-MM")), p, ["month"])
    assert spark.read.parquet(p).count() == d.count()
    e = str(tmp_path / "e")
    pred = d.select(F.col("ds").alias("date"), "customer_id", "product_id", F.lit("x").alias("city"),
                    F.col("order_qty").cast("int").alias("pred_order_qty"))
    sk.export_predictions(pred, e, page=2, size=10)
    assert spark.read.option("header", True).csv(e).count() == 10
    m = str(tmp_path / "m")
    sk.write_metrics(spark.createDataFrame([(1.5, 2.5)], "train_mae double, test_mae double"), m)
    files = [f for f in os.listdir(m) if f.endswith(".json")]
    assert json.loads(open(os.path.join(m, files[0])).readline())["test_mae"] == 2.5


def test_append_log_and_stream(spark, tmp_path):
    from ebbflow.streaming.adjustment_log import start_adjustment_log
    src = str(tmp_path / "events")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.write.parquet(src)
    sink, ckpt = str(tmp_path / "log"), str(tmp_path / "ckpt")
    q = start_adjustment_log(spark, src, sink, ckpt)
    q.awaitTermination(120)
    log = spark.read.parquet(sink)
    assert log.count() == ev.count()
    assert {"new_value", "change", "log_day"} <= set(log.columns)
    # a second run over the same files appends nothing (checkpointed offsets)
    q2 = start_adjustment_log(spark, src, sink, ckpt)
    q2.awaitTermination(120)
    assert spark.read.parquet(sink).count() == ev.count()


def test_replayed_log_batch_is_not_appended_twice(spark, tmp_path):
    sink = str(tmp_path / "log")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(3, "z")], "k int, v string")
    sk.append_log(a, sink, batch_id=0)
    sk.append_log(a, sink, batch_id=0)          # replay of epoch 0
    assert spark.read.parquet(sink).count() == 2
    sk.append_log(b, sink, batch_id=1)
    log = spark.read.parquet(sink)
    assert log.count() == 3 and sorted(r.k for r in log.collect()) == [1, 2, 3]


def test_a_fresh_stream_adds_to_an_existing_log(spark, tmp_path):
    """Batch rows, a stream and a second stream with a checkpoint of its own
    share one log; none replaces another's rows."""
    from ebbflow.streaming.adjustment_log import start_adjustment_log
    sink = str(tmp_path / "log")
    ev = spark.read.parquet(f"{SF}/events.parquet").limit(40)
    sent = 0
    for i in (1, 2):
        src = str(tmp_path / f"events{i}")
        ev.withColumn("event_id", F.col("event_id") + 1000 * i).write.parquet(src)
        start_adjustment_log(spark, src, sink, str(tmp_path / f"ckpt{i}")).awaitTermination(120)
        sent += 40
        assert spark.read.parquet(sink).count() == sent
    more = spark.read.parquet(sink).drop("log_day", "writer", "batch_id").limit(5)
    sk.append_log(more, sink, id_col="adjustment_id")
    assert spark.read.parquet(sink).count() == sent + 5


def test_sources_with_only_bad_dates_are_reported(spark, tmp_path):
    root = str(tmp_path / "raw")
    _write(f"{root}/a.csv", "order_id,date,revenue\n1,1/31/2018 22:56,5\n2,soon,6\n", "utf-8")
    _write(f"{root}/b.csv", "order_id,date,revenue\n3,soon,7\n4,later,8\n", "utf-8")
    df, skipped = rd.read_folder_union(spark, root)
    assert [(r.order_id, str(r.order_date)) for r in df.collect()] == [("1", "2018-01-31 22:56:00")]
    assert [(os.path.basename(p), why) for p, why in skipped] == [("b.csv", "no row with a valid date")]


def test_series_arrays_to_rows(spark):
    df = spark.createDataFrame([("a", ["d1", "d2"], [1.0, 2.0], [3.0, 4.0], [4.0, 6.0])],
                               "k string, ds array<string>, base_forecast array<double>, promotional_forecast array<double>, total_forecast array<double>")
    rows = sk.export_series(df, ["k"])
    assert [tuple(r) for r in rows.orderBy("ds").collect()] == [("a", "d1", 1.0, 3.0, 4.0), ("a", "d2", 2.0, 4.0, 6.0)]
    assert sk.export_series(rows, ["k"]).collect() == rows.collect()


def test_flatten_nested(spark):
    df = spark.createDataFrame([(1, (2.5, "x"), [3, 4])], "id int, s struct<a:double,b:string>, arr array<int>")
    rows = {(r.field, r.value) for r in sk.flatten_record(df, keys=["id"]).collect()}
    assert rows == {("s.a", "2.5"), ("s.b", "x"), ("arr[0]", "3"), ("arr[1]", "4")}


def test_cluster_session_needs_shared_checkpoint_dir():
    """Outside local mode an unset spark.checkpoint.dir is refused rather than
    replaced by a machine-local folder."""
    from types import SimpleNamespace

    from ebbflow.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://cluster:7077",
                         setCheckpointDir=lambda d: (_ for _ in ()).throw(AssertionError(d)))
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d))
    for sc.master in ("spark://cluster:7077", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(fake)


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    """60 files of two headers, some after blank lines, two encodings: one job for the heads whatever the number of files."""
    root = str(tmp_path / "many")
    for i in range(60):
        head = "order_id,order_date,city\n" if i % 2 else "city,order_date,order_id\n"
        values = f"{i},2024-01-{i % 28 + 1:02d},Zürich\n" if i % 2 else f"Zürich,2024-01-{i % 28 + 1:02d},{i}\n"
        _write(f"{root}/{i % 5}/f{i}.csv", ("\n" if i % 3 == 0 else "") + head + values, "utf-8" if i % 4 < 2 else "iso-8859-1")
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("heads", "heads")
    heads = rd.file_heads(spark, rd.list_files(spark, root))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("heads")) <= 3
    assert {h for _, _, h in heads.values()} == {b"order_id,order_date,city", b"city,order_date,order_id"}
    assert sorted({e for _, e, _ in heads.values()}) == ["iso-8859-1", "utf-8"]
    df, skipped = rd.read_folder_union(spark, root)
    assert skipped == [] and sorted(int(r["order_id"]) for r in df.select("order_id", "city").collect()) == list(range(60))
    assert {r["city"] for r in df.select("city").distinct().collect()} == {"Zürich"}
