"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits come from word shingles.  Two fingerprints that differ
in at most ``max_bits`` bits, cut into ``segments`` segments on a ring, have
(by the pigeonring principle) a segment from which every chain of l consecutive
segments differs in at most l * max_bits / segments bits.  The first links of
that chain have budgets below one bit, that is, they are equal: they are the
join key.  The further links are checked in order before the whole distance.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_of, orderable, settled
from .graph import components

#: Shingles whose bits are counted at once: bounds memory for very long texts.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the
    shingles' hashes (XXH64, seed 42).  Null and wordless texts give 0; a text
    with fewer words than a shingle is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()     # bytes: A-Z and ASCII space only
    if not words:
        return 0
    if len(words) <= shingle:
        grams, n = iter([b" ".join(words)]), 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    while True:
        h = np.array([xxhash.xxh64_intdigest(g, 42) for g in itertools.islice(grams, CHUNK)], np.uint64)
        if not h.size:
            break
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, *more: Column) -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``more`` of every row; a null text is empty."""
    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    return docs.select("doc_id", fp(F.col("text")).alias("fp"), *more)


def _masks(segments: int) -> list[int]:
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(fps: DataFrame, max_bits: int = 2, segments: int = 5, dense: int = 64) -> DataFrame:
    """Links (``a``, ``b``) between distinct values of ``fp`` that connect all
    pairs which differ in at most ``max_bits`` bits.

    Every fingerprint is put under one key for each start on the ring (its
    leading chain of equal segments).  Keys with up to ``dense`` fingerprints
    are joined with themselves, candidates go through the chain budgets and
    then the whole distance.  Fuller keys are not paired: there every
    fingerprint is listed under each value within one bit of it outside the
    key.  Two fingerprints share such a value exactly if they differ in two
    bits or fewer, and a value has 65 fingerprints at most; those that share
    one are linked to the least of them.  So no link is lost and no key,
    however full, makes a quadratic number of rows."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    masks = _masks(segments)
    budget = [(n * max_bits) // segments for n in range(segments + 1)]      # of a chain of n segments
    equal = max((n for n in range(1, segments) if budget[n] == 0), default=0)
    if not equal:
        raise ValueError("more segments than bits are needed")

    def chain(start: int, n: int) -> int:
        return _signed(sum(masks[(start + i) % segments] for i in range(n)))

    one = fps.select("fp").where("fp is not null").distinct()
    keyed = settled(one.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(chain(i, equal)).cast("long")).alias("key"))
        for i in range(segments)])).alias("k")).select("k.start", "k.key", "fp"))
    size = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = settled(keyed.join(size, ["start", "key"]))

    few = held.where(F.col("n") <= dense).select("start", "key", "fp")
    pairs = (few.select("start", "key", F.col("fp").alias("a"))
             .join(few.select("start", "key", F.col("fp").alias("b")), ["start", "key"]).where("a < b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    for n in range(equal + 1, segments + 1):        # prefix chains first, the whole distance last
        within = F.lit(False)
        for i in range(segments):
            within = within | ((F.col("start") == i) & (F.bit_count(differ.bitwiseAND(F.lit(chain(i, n)).cast("long"))) <= budget[n]))
        pairs = pairs.where(within)
    pairs = pairs.where(F.bit_count(differ) <= max_bits).select("a", "b")

    if max_bits == 0:
        return pairs            # distinct fingerprints never agree in all bits
    keys = [sum(masks[(i + j) % segments] for j in range(equal)) for i in range(segments)]
    around = F.array(F.col("fp"), *[
        F.when(F.col("start").isin([i for i in range(segments) if not keys[i] >> b & 1]),
               F.col("fp").bitwiseXOR(F.lit(_signed(1 << b)).cast("long"))) for b in range(64)])
    many = (held.where(F.col("n") > dense).select("fp", F.explode(around).alias("v")).where("v is not null"))
    hubs = many.groupBy("v").agg(F.collect_set("fp").alias("all"))      # at most 65 within one bit of a value
    stars = (hubs.where(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
             .where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    if max_bits == 1:       # members of a hub may be two bits apart: only pairs with the value itself are links
        stars = (hubs.where(F.array_contains("all", F.col("v"))).select(F.col("v").alias("a"), F.explode("all").alias("b"))
                 .where("a <> b"))
    return pairs.unionAll(stars).distinct()


def _roots(fps: DataFrame, max_bits: int, segments: int, dense: int) -> DataFrame:
    """``fp``, ``root`` (least fingerprint of its component), ``least`` (doc_id)."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(fps, max_bits, segments, dense)).withColumnRenamed("node", "fp")
    return settled(least.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, segments: int = 5,
                    dense: int = 64) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` per row:
    the smallest doc_id that can be reached over links, the row's own included.

    Null texts count as empty; all empty texts share fingerprint zero and are
    linked like others.  Repeated rows each get a row.  Null ids never are a
    component's id unless it has no other.  An empty table gives no rows.
    Only columns doc_id and text are read, so others may have any name."""
    fps = settled(fingerprints(docs, shingle))
    named = _roots(fps, max_bits, segments, dense)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, segments: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id,
    of its texts the one with the least hash, and of rows that repeat both the
    first by the other columns.  Rows without an id come after all others of
    their group."""
    fps = settled(fingerprints(docs, shingle, F.xxhash64("text").alias("_mark")))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), key_of(F.col("doc_id")).alias("key"), F.col("_mark").alias("mark"))
    by_fp = fps.groupBy("fp").agg(F.min(rank).alias("first"))       # of each fingerprint, then of each group
    keep = (by_fp.join(_roots(fps, max_bits, segments, 64).select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
            .select(F.col("first.key").alias("_keep"), F.col("first.mark").alias("_mark")))
    cols = [docs[c] for c in docs.columns]
    key = key_of(docs["doc_id"])
    rows = docs.select(key.alias("_key"), F.xxhash64(docs["text"]).alias("_text"),
                       F.struct(*cols).alias("_row"), F.struct(*[docs[c] for c in orderable(docs, ["text"])]).alias("_order"))
    first = W.partitionBy("_key", "_text").orderBy("_order")
    return (rows.join(keep, (F.col("_key") == F.col("_keep")) & (F.col("_text") == F.col("_mark")), "left_semi")
            .withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select("_row.*"))
