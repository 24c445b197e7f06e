"""Streaming form of the adjustment log (A12 + J01).

Adjustment events arrive as files; each micro-batch is resolved (J01) and
appended to the day-partitioned log with ``foreachBatch`` -- the only
continuous write of the reference.  With ``trigger(availableNow=True)`` the
same code runs as an incremental batch job; the checkpoint location (a
shared folder) makes it restartable after executor or driver loss, and each
micro-batch writes its own (day, stream, batch) partitions by dynamic overwrite,
so a batch replayed after a failure is not appended twice, and a stream with a
fresh checkpoint adds to an existing log instead of replacing its batches.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adjust import apply_adjustments
from ..sources.fixtures import ADJUSTMENT_TYPES
from ..sources.sinks import append_log


def events_to_adjustments(ev: DataFrame) -> DataFrame:
    """The fixture mapping of events to adjustment records (see sources.fixtures)."""
    kind = (F.when(F.col("event_id") % 3 == 0, F.lit(ADJUSTMENT_TYPES[0]))
             .when(F.col("event_id") % 3 == 1, F.lit(ADJUSTMENT_TYPES[1]))
             .otherwise(F.lit(ADJUSTMENT_TYPES[2])))
    return ev.select(
        F.col("event_id").alias("adjustment_id"),
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("sku_id"),
        F.to_date("ts").alias("target_date"), F.col("value").alias("current_value"),
        F.when(F.col("event_id") % 7 == 0, F.col("value") * 2).alias("new_forecast_value"),
        kind.alias("adjustment_type"),
        F.get_json_object("props", "$.k").cast("double").alias("adjustment_value"),
        F.col("event_type").alias("reason_category"), F.col("ts").alias("created_at"))


def start_adjustment_log(spark: SparkSession, source: str, sink: str, checkpoint: str,
                         available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream: parquet event files -> adjustments -> appended log."""
    schema = spark.read.parquet(source).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = apply_adjustments(events_to_adjustments(r.parquet(source)))

    def write(batch: DataFrame, epoch: int) -> None:
        # the checkpoint's metadata holds the stream's id, which outlives restarts
        writer = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        # idempotent per epoch: a replayed micro-batch overwrites its own partitions
        append_log(batch, sink, ts="created_at", id_col="adjustment_id", batch_id=epoch, writer=writer)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
