"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.session import ensure_checkpoint_dir

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Key that stands for a null id in joins and windows (no table uses it as an id).
NULL_KEY = -(2 ** 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the given folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as Parquet to the shared folder of
    ``spark.checkpoint.dir``: later steps read it from there, also after the
    loss of executors.  The table goes when the application ends."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, each lengthened by underscores until ``df`` has no
    such column (names compare without case, as Spark resolves them)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would map other letters too)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Words in the text; 0 when it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column) -> Column:
    """``doc_id`` with null replaced, for equality joins that keep null ids."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_KEY))


def orderable(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    """Columns that can be sorted on, without those in ``but``."""
    skip = {c.lower() for c in but}
    return [f.name for f in df.schema.fields
            if f.name.lower() not in skip and f.dataType.typeName() not in ("map", "variant")
            and "map<" not in f.dataType.simpleString()]
