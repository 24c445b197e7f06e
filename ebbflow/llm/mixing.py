"""Mixing sources to target weights by weighted fair queueing.

Every source has a target: its share of the budget by weight, at most
``copies`` times its size.  A source's documents are shuffled by a hash and
queue up; a document's virtual finish time is the source's words up to its end
divided by the target.  All queues are served in order of that time, so at
virtual time v every source has given v times its target, and the budget is
used up at time 1: there the globally sorted queue is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbflow.operators.clean import running_offsets

from .common import fresh, n_words, settled

#: Hex digits of the shuffle hash that name a bucket: 16**3 buckets a source.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame, weights: Sequence[int], share: float, copies: int) -> DataFrame:
    """Target of every source, from ``none`` (1 for the null source), ``name``
    and ``total``.

    Sources in code-point order, null last, weigh ``weights`` in turn.  The
    budget is ``share`` times all words.  A source is full at level
    copies * total / weight; with the sources in that order the first one at
    whose level the budget is reached gives the common level, and every target
    is the lesser of its own limit and weight times that level (which is what
    resharing the excess by weight ends in).  Running totals are taken range by
    range: no task or driver gets all sources."""
    ranked = running_offsets(sizes.withColumn("one", F.lit(1).cast("long")), ["none", "name"], "one")
    turn = F.pmod(F.col("_off"), F.lit(len(weights))).cast("int")
    weighed = settled(ranked.select("none", "name", "total", F.element_at(
        F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1).alias("weight"))
        .withColumn("limit", F.col("total") * copies).withColumn("level", F.col("limit") / F.col("weight")))
    order = ["level", "none", "name"]
    by_limit = running_offsets(weighed, order, "limit").withColumnRenamed("_off", "full")
    by_both = running_offsets(by_limit, order, "weight").withColumnRenamed("_off", "lighter")
    all_ = weighed.agg(F.sum("weight").alias("all_weight"), (F.sum("total") * F.lit(float(share))).alias("budget"))
    reached = by_both.crossJoin(F.broadcast(all_))      # one row
    left = F.col("all_weight") - F.col("lighter")
    level = (reached.where(F.col("full") + F.col("level") * left >= F.col("budget"))
             .select(F.struct("level", (F.col("budget") - F.col("full")) / left).alias("x")).agg(F.min("x").alias("x"))
             .select(F.col("x.col2").alias("common")))
    return (weighed.crossJoin(F.broadcast(level))
            .select("none", "name", "total", "weight", F.when(F.col("common").isNull(), F.col("limit").cast("double"))
                    .otherwise(F.least(F.col("limit").cast("double"), F.col("weight") * F.col("common"))).alias("target")))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, copies: int = 2) -> DataFrame:
    """``docs`` in the order of the mix, with ``size`` (words), ``source_size``,
    ``target`` (of the source), ``taken`` (words that the mix takes, repeats
    counted) and ``finish`` (virtual finish time of the first copy).  Where a
    column of ``docs`` has such a name, the new one is lengthened by an underscore.

    The document in service when the budget ends is taken up to there, so a
    source's words add up to its target, rounded down.  A source that must
    repeat starts over after its last document.  The shuffle is by the MD5 of
    the id and cut into buckets of equal chance, so a source with a third of
    all rows is spread over thousands of groups and reruns agree.  Null texts
    have size 0 and are never taken; null sources are a source; rows that
    repeat an id queue one after the other; an empty table gives no rows."""
    size, source_size, target, taken, finish = fresh(docs, "size", "source_size", "target", "taken", "finish")
    none, name, mark, bucket, before = fresh(docs, "_none", "_name", "_mark", "_bucket", "_before")
    rows = docs.withColumns({
        size: n_words(docs["text"]), none: docs["source"].isNull().cast("int"), name: F.coalesce(docs["source"], F.lit("")),
        mark: F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary"))})
    rows = rows.withColumn(bucket, F.substring(mark, 1, BUCKET_DIGITS))
    sums = settled(rows.groupBy(F.col(none).alias("none"), F.col(name).alias("name"), F.col(bucket).alias("bucket"))
                   .agg(F.sum(size).alias("words")))
    aims = targets(sums.groupBy("none", "name").agg(F.sum("words").alias("total")), weights, share, copies)
    start = F.coalesce(F.sum("words").over(W.partitionBy("none", "name").orderBy("bucket")
                                           .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = (sums.withColumn("start", start).join(aims.withColumnsRenamed({"none": "n2", "name": "s2"}),
                                                 (F.col("none") == F.col("n2")) & (F.col("name") == F.col("s2")))
            .select(F.col("none").alias(none), F.col("name").alias(name), F.col("bucket").alias(bucket), F.col("start").alias("_start_"),
                    F.col("total").alias("_total_"), F.col("target").alias("_target_")))
    queue = W.partitionBy(none, name, bucket).orderBy(mark, "doc_id", size).rowsBetween(W.unboundedPreceding, -1)
    out = (rows.join(plan, [none, name, bucket])
           .withColumn(before, F.col("_start_") + F.coalesce(F.sum(size).over(queue), F.lit(0))))
    whole = F.floor("_target_")
    served = [F.greatest(F.lit(0), F.least(F.col(size), whole - F.col(before) - F.col("_total_") * c)) for c in range(copies)]
    return (out.select(*[out[c] for c in docs.columns], F.col(size), F.col("_total_").alias(source_size),
                       F.col("_target_").alias(target), sum(served[1:], served[0]).cast("long").alias(taken),
                       F.when(F.col("_target_") > 0, (F.col(before) + F.col(size)) / F.col("_target_")).alias(finish))
            .orderBy(F.col(finish).asc_nulls_last(), "doc_id"))


#: The same in SQL (DuckDB), for the documents table with the defaults above.
MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS mark
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS total FROM rows GROUP BY source),
weighed AS (
  SELECT source, total, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sizes),
levels AS (
  SELECT source, total, weight, 2 * total AS lim, (2 * total)::DOUBLE / weight AS level,
         (sum(total) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
         (sum(weight) OVER ())::BIGINT AS all_weight FROM weighed),
ordered AS (
  SELECT *, coalesce(sum(lim) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_,
         coalesce(sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lighter
  FROM levels),
common AS (
  SELECT (budget - full_) / (all_weight - lighter)::DOUBLE AS v FROM ordered
  WHERE full_ + level * (all_weight - lighter) >= budget ORDER BY level, v LIMIT 1),
aims AS (SELECT source, total, least(lim::DOUBLE, weight * (SELECT v FROM common)) AS target FROM ordered),
queued AS (
  SELECT doc_id, size, source, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mark, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM rows)
SELECT q.doc_id, q.size, a.total AS source_size, a.target,
       (greatest(0, least(q.size, floor(a.target)::BIGINT - q.before))
        + greatest(0, least(q.size, floor(a.target)::BIGINT - q.before - a.total)))::BIGINT AS taken,
       CASE WHEN a.target > 0 THEN (q.before + q.size) / a.target END AS finish
FROM queued q JOIN aims a ON q.source IS NOT DISTINCT FROM a.source
"""
