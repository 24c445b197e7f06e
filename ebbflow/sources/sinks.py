"""Writers (A08-A12, A14) and result flattening (A10).

Every writer is a distributed ``DataFrame.write``; nothing is collected.
Paths are shared-filesystem locations on a cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """Persist a table, optionally partitioned (e.g. by order month, so
    date filters prune whole directories)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def export_predictions(df: DataFrame, path: str, page: int | None = None, size: int = 5000,
                       order: Sequence[str] = ("date", "customer_id", "product_id", "city")) -> None:
    """One page (1-based, at most ``size`` rows) or all predictions as CSV."""
    cols = [c for c in order if c in df.columns]
    x = df.orderBy(*cols) if cols else df
    if page is not None:
        x = x.offset((page - 1) * size).limit(size)
    x.write.mode("overwrite").option("header", True).csv(path)


def flatten_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Leaf paths of a nested schema (arrays are leaves; ``posexplode`` them)."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += flatten_paths(f.dataType, name + ".")
        else:
            out.append((name, f.dataType))
    return out


def flatten_record(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A10: nested rows to (keys..., field, value) rows: one ``stack``-like
    explode of a map from leaf path to value text; array elements become
    ``field[i]``."""
    leaves = [(p, t) for p, t in flatten_paths(df.schema) if p not in keys]
    pairs = []
    arrays = []
    for p, t in leaves:
        col = F.col("`" + "`.`".join(p.split(".")) + "`")
        if isinstance(t, T.ArrayType):
            arrays.append((p, col))
        else:
            pairs += [F.lit(p), col.cast("string")]
    x = df.select(*keys, F.explode(F.create_map(*pairs)).alias("field", "value")) if pairs else None
    for p, col in arrays:
        a = df.select(*keys, F.posexplode(col).alias("_i", "_v")).select(
            *keys, F.concat(F.lit(p + "["), F.col("_i").cast("string"), F.lit("]")).alias("field"),
            F.col("_v").cast("string").alias("value"))
        x = a if x is None else x.unionByName(a)
    return x


def to_json_rows(df: DataFrame) -> DataFrame:
    """A10: each row as one JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def to_xml_rows(df: DataFrame, row_tag: str = "row") -> DataFrame:
    """A10: each row as one XML element."""
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": row_tag}).alias("xml"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A one-row metrics table as JSON (one file)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, ts: str = "created_at", id_col: str = "log_id",
               batch_id: int | None = None, writer: str = "batch") -> None:
    """Append records with an id and creation time to (day, writer, batch)
    partitions; batch jobs and streams share one layout and may share a path.

    The id is a hash of the record, so a retried batch writes the same ids.
    Rows with a ``batch_id`` (a streaming epoch) are written with dynamic
    partition overwrite: a micro-batch replayed after a failure replaces its
    own partitions.  ``writer`` names the stream (its checkpoint's id), so a
    stream that starts over with a fresh checkpoint replaces nothing of an
    earlier one.  Without a ``batch_id`` rows are appended."""
    x = df
    if ts not in x.columns:
        x = x.withColumn(ts, F.current_timestamp())
    if id_col not in x.columns:
        x = x.withColumn(id_col, F.sha2(F.to_json(F.struct(*[c for c in df.columns])), 256).substr(1, 16))
    x = x.withColumns({"log_day": F.to_date(ts), "writer": F.lit(writer),
                       "batch_id": F.lit(-1 if batch_id is None else int(batch_id)).cast("long")})
    out = x.write.partitionBy("log_day", "writer", "batch_id")
    if batch_id is None:
        out.mode("append").parquet(path)
    else:
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def export_series(fc: DataFrame, keys: Sequence[str], ds: str = "ds",
                  cols: Sequence[str] = ("base_forecast", "promotional_forecast", "total_forecast")) -> DataFrame:
    """A forecast per series, as parallel arrays (dates, base, promo,
    total) in columns of those names, to one row per date.  A forecast that has
    one row per date already is passed on as it is: no shuffle."""
    if not isinstance(fc.schema[ds].dataType, T.ArrayType):
        return fc.select(*keys, ds, *cols)
    z = fc.select(*keys, F.explode(F.arrays_zip(*[F.col(c) for c in (ds, *cols)])).alias("_z"))
    return z.select(*keys, *[F.col("_z")[c].alias(c) for c in (ds, *cols)])


def write_series_csv(fc: DataFrame, path: str, keys: Sequence[str], ds: str = "ds") -> None:
    export_series(fc, keys, ds).write.mode("overwrite").option("header", True).csv(path)
