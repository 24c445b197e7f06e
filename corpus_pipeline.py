"""Cleaning of a document corpus in five stages, each an operator of ``ebbflow.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm import decontaminate, mixing, pii, quality, simhash
from ebbflow.llm.common import fresh, table
from ebbflow.llm.queries import MAX_BITS, SHINGLE
from ebbflow.session import ensure_checkpoint_dir

#: No SQL: compression, edit distances and personal data have no SQL form
#: (tests/llm compares the stages with brute force).
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier scores at least one half.  It
    learns from the folder's labels and the texts of ``docs``, never from
    held-out ids; without labels nothing is rejected."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), usable=~quality.held_out(F.col("doc_id")))
    name, = fresh(docs, "score")
    return docs.withColumn(name, quality.score(docs["text"], model)).where(F.col(name) >= 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id."""
    return simhash.keep_one(docs, SHINGLE, MAX_BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item in their text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; identifiers in the text replaced by their kinds."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the mix takes words, in its order, with the mix's columns."""
    mixed = mixing.mix(docs)
    taken = mixed.columns[-2]
    return mixed.where(F.col(taken) > 0)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", redact_personal_data), ("mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage results are kept as Parquet in the
    shared folder of ``spark.checkpoint.dir``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
