"""One-permutation MinHash fingerprints, native.

The shingles of a text are hashed once.  The top bits of a hash name one of
``bins`` bins, the least hash of a bin is its value.  An empty bin takes the
value of the first filled one in a random sequence of bins of its own (optimal
densification).  Of every value the low ``bits`` bits are kept; the share of
bins that agree, less what agrees by chance, estimates the similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, key_of, settled

BINS, BITS = 128, 8
_BIN_BITS = 7       # log2 of BINS
#: Steps of an empty bin's sequence looked at together; a later group only if all before it are empty.
_PROBES = ((1, 6), (7, 40), (41, 160), (161, 640))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - _BIN_BITS).cast("int")


def fingerprint(df: DataFrame, text: str, out: str, shingle: int = 5) -> DataFrame:
    """``df`` with ``out``: the low bits of every bin's value packed as an array
    of BINS bytes (less 128); empty for a text without words.  A text with fewer words than
    a shingle is one shingle.  Every step is a column of its own, so Spark
    computes it once."""
    words, hashed, grams, ordered, least, low, high = (f"_{out}_{i}" for i in range(7))
    df = df.withColumn(words, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))
    df = df.withColumn(hashed, F.transform(words, lambda w: F.xxhash64(w)))
    at = F.col(hashed)
    df = df.withColumn(grams, F.when(F.size(hashed) >= shingle, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(hashed) - shingle, F.lit(0))), lambda i: F.xxhash64(*[at[i + j] for j in range(shingle)])))
        .when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(ordered, F.sort_array(grams))
    seq = F.col(ordered)
    # equal top bits stand together: the first of each run is the bin's least
    df = df.withColumn(least, F.filter(seq, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(seq, i - 1)))))
    half = BINS // 2

    def mask(upper: bool) -> Column:        # which bins of this half are filled, as the bits of a long
        return F.aggregate(F.filter(least, lambda h: (_bin(h) >= half) == F.lit(upper)), F.lit(0).cast("long"),
                           lambda m, h: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(_bin(h), F.lit(half)))))
    df = df.withColumns({low: mask(False), high: mask(True)})
    lo, hi, mins = F.col(low), F.col(high), F.col(least)

    def side(b: Column) -> Column:
        return F.when(b >= half, hi).otherwise(lo)

    def filled(b: Column) -> Column:
        return F.call_function("shiftright", side(b), F.pmod(b, F.lit(half))).bitwiseAND(F.lit(1).cast("long")) == 1

    def value(b: Column) -> Column:     # sorted as signed numbers the upper half of the bins comes first
        below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.pmod(b, F.lit(half))))
        rank = F.bit_count(side(b).bitwiseAND(below)) + F.when(b >= half, 0).otherwise(F.bit_count(hi))
        return F.get(mins, rank)

    def borrowed(b: Column) -> Column:
        tries = [F.get(F.filter(F.transform(F.sequence(F.lit(a), F.lit(z)), lambda t: F.pmod(F.xxhash64(b, t), F.lit(BINS)).cast("int")), filled), F.lit(0))
                 for a, z in _PROBES]
        return F.coalesce(*[value(t) for t in tries], F.get(mins, F.lit(0)))

    every = F.sequence(F.lit(0), F.lit(BINS - 1))

    def bits(v: Column) -> Column:
        return (v.bitwiseAND(F.lit(2 ** BITS - 1).cast("long")) - 128).cast("byte")

    packed = F.transform(every, lambda b: bits(F.when(filled(b), value(b)).otherwise(borrowed(b))))
    full = (F.when(F.size(least) == 0, F.array().cast("array<tinyint>"))
            .when(F.size(least) == 1, F.array_repeat(bits(F.get(mins, F.lit(0))), BINS)).otherwise(packed))
    return df.withColumn(out, full).drop(words, hashed, grams, ordered, least, low, high)


def as_text(fp: Column) -> Column:
    """The packed bits as hex digits (BITS is 8: two a bin); empty for no words."""
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v.cast("int") + 128)), 2, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: agreement less chance.  Two texts
    without words are alike, one without words is unlike any other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 2.0 ** -BITS
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
            .otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance))))


def neighbours(keys: DataFrame) -> DataFrame:
    """``k``, ``after``, ``before`` for distinct keys in descending order, as a
    ring: after the last comes the first.  Keys are dealt out by range; what
    crosses a border comes from one row per range, so no task gets all keys."""
    spark = keys.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = settled(keys.select("k").distinct().repartitionByRange(n, F.col("k").desc()).withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max("k").alias("top"), F.min("k").alias("bottom"))
    whole, order = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("part")     # a row per range
    ends = ends.select("part", F.coalesce(F.lead("top").over(order), F.max("top").over(whole)).alias("next_top"),
                       F.coalesce(F.lag("bottom").over(order), F.min("bottom").over(whole)).alias("last_bottom"))
    inside = W.partitionBy("part").orderBy(F.col("k").desc())
    return (ranged.join(F.broadcast(ends), "part")
            .select("k", F.coalesce(F.lead("k").over(inside), "next_top").alias("after"),
                    F.coalesce(F.lag("k").over(inside), "last_bottom").alias("before")))


def edited(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third of
    its code points (rounded down) replaced by as many from the start of the
    next document, by descending id, after the last the first.

    Null ids come last.  Rows that repeat an id each have the same next
    document; where the next id is repeated its first text (by hash, then
    length) counts.  Null texts are empty.  Only doc_id and text are read.

    Texts are dealt out by id once; besides that only the starts that stand in
    for the edited thirds move, and narrow tables of ids and fingerprints."""
    base = docs.select("doc_id", key_of(F.col("doc_id")).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    # the longest part that a document with this id asks of the next
    wants = base.groupBy("k").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("third"))
    ring = neighbours(base)
    asked = (ring.join(wants.select(F.col("k").alias("before"), F.col("third").alias("asked")), "before")
             .select("k", "after", "before", "asked"))
    own = settled(fingerprint(base.select("k", F.xxhash64("text").alias("mark"), F.length("text").alias("n"), "text"), "text", "fp", shingle)
                  .select("k", "mark", "n", "fp").distinct())
    rows = base.withColumn("mark", F.xxhash64("text")).join(asked, "k")
    # doc_id decides nothing here: with it both sides ask for the same columns of the same
    # exchange, and Spark deals the texts out once for the two
    first = W.partitionBy("k").orderBy("mark", F.length("text"), "doc_id")
    starts = (rows.withColumn("nth", F.row_number().over(first)).where("nth = 1")
              .select(F.col("before").alias("k"), F.expr("substring(text, 1, asked)").alias("start")))
    lead = own.withColumn("nth", F.row_number().over(W.partitionBy("k").orderBy("mark", "n"))).where("nth = 1")
    next_fp = ring.join(lead.select(F.col("k").alias("after"), F.col("fp").alias("next_fp")), "after").select("k", "next_fp")
    fps = own.join(next_fp, "k").select(F.col("k").alias("k_"), F.col("mark").alias("mark_"), F.col("n").alias("n_"), "fp", "next_fp")
    both = (rows.select("doc_id", "k", "mark", "text").join(starts, "k")
            .withColumn("n", F.length("text")).withColumn("third", F.floor(F.col("n") / 3).cast("int"))
            .withColumn("edited", F.expr("concat(substring(text, 1, n - third), substring(start, 1, third))"))
            .select("doc_id", "k", "mark", "n", "edited"))
    both = fingerprint(both, "edited", "edited_fp", shingle).select(
        "doc_id", "k", "mark", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "edited_fp")
    return (both.join(fps, (F.col("k") == F.col("k_")) & (F.col("mark") == F.col("mark_")) & (F.col("n") == F.col("n_")))
            .select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
                    as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("next_fp")).alias("near_next")))
