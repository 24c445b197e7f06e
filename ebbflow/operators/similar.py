"""Similar ids: pairs of strings within an insert/delete budget, and the
matching-block ratio, as joins and built-in functions only.

The ratio of two strings is 2M / T: T their lengths together, M the characters
of the matching blocks -- the longest common substring (of equals the first in
the left string, then in the right one), then the same on both sides of it.
The blocks are a common subsequence, so a pair of ratio r is at most
(1 - r) T inserts and deletes apart; that budget decides how a pair is found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Variants of an id that a pair of lengths may cost, deletions of a variant, lengths with a table entry.
MOST_VARIANTS, MOST_DELETIONS, MOST_LENGTH = 700, 4, 256
Q = 3


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(s: Column, begin, length) -> Column:
    return s.substr(begin if isinstance(begin, Column) else F.lit(begin), length)


def longest_block(x: Column, y: Column) -> Column:
    """Struct (i, j, l): the longest common substring of two non-empty strings,
    from 1; l is 0 without one.  A common substring of a length has one of each
    smaller length, so the length is found by bisection."""
    def common(n: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.position(_part(x, i, n), y) > 0)

    def halve(s: Column, _):
        return _let(F.floor((s["low"] + s["high"] + 1) / 2).cast("int"),
                    lambda m: F.when(s["low"] >= s["high"], s).when(common(m), F.struct(m.alias("low"), s["high"].alias("high")))
                    .otherwise(F.struct(s["low"].alias("low"), (m - 1).alias("high"))))

    least = F.least(F.length(x), F.length(y))
    size = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(least + 1)).cast("int") + 1),
                       F.struct(F.lit(0).alias("low"), least.alias("high")), halve, lambda s: s["low"])
    return _let(size, lambda n: _let(
        F.element_at(F.filter(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.position(_part(x, i, n), y) > 0), 1),
        lambda i: F.struct(i.alias("i"), F.position(_part(x, i, n), y).alias("j"), n.alias("l"))))


def matching_ratio(a: Column, b: Column, budget: Column) -> Column:
    """Matching-block ratio of two non-empty strings, or null where it takes
    more than ``budget`` inserts and deletes to get from one to the other by
    the blocks.  A pair within the budget has budget + 1 blocks at most, so
    twice that many parts are looked at."""
    start = F.struct(F.array(F.struct(a.alias("x"), b.alias("y"))).alias("todo"), F.lit(0).alias("matched"))

    def step(s: Column, _):
        def split(p: Column) -> Column:
            def with_block(m: Column) -> Column:
                sides = F.array(
                    F.struct(_part(p["x"], 1, m["i"] - 1).alias("x"), _part(p["y"], 1, m["j"] - 1).alias("y")),
                    F.struct(_part(p["x"], m["i"] + m["l"], F.length(p["x"])).alias("x"),
                             _part(p["y"], m["j"] + m["l"], F.length(p["y"])).alias("y")))
                more = F.filter(sides, lambda q: (m["l"] > 0) & (F.length(q["x"]) > 0) & (F.length(q["y"]) > 0))
                rest = F.slice(s["todo"], F.lit(1), F.size(s["todo"]) - 1)
                return F.struct(F.concat(rest, more).alias("todo"), (s["matched"] + m["l"]).alias("matched"))
            return _let(longest_block(p["x"], p["y"]), with_block)
        return F.when(F.size(s["todo"]) == 0, s).otherwise(_let(F.element_at(s["todo"], -1), split))

    total = F.length(a) + F.length(b)
    matched = F.aggregate(F.sequence(F.lit(1), 2 * budget + 3), start, step,
                          lambda s: F.when(F.size(s["todo"]) == 0, s["matched"]))
    return _let(matched, lambda m: F.when(total - 2 * m <= budget, (2 * m).cast("double") / total))


def budget_of(la, lb, ratio: float) -> Column:
    return F.floor((1 - ratio) * (la + lb) + 1e-9).cast("int")


def _min_shared_grams(length: int, ratio: float) -> int:
    """Fewest positional q-grams that a string of this length shares with any
    partner of the ratio: each insert or delete destroys at most Q of them."""
    lo = ratio / (2 - ratio)
    best = None
    for other in range(max(1, int(length * lo) - 1), int(length / lo) + 3):
        if min(length, other) / max(length, other) >= lo:
            k = int((1 - ratio) * (length + other) + 1e-9)
            shared = max(length, other) - Q + 1 - Q * k
            best = shared if best is None else min(best, shared)
    return 0 if best is None else best


def _shared_grams(length: Column, ratio: float) -> Column:
    """``_min_shared_grams`` of any length (a little lower): the bound falls by
    2 Q (1 - ratio) a character up to the same length, and by Q (1 - ratio) - 1,
    where that is more than nothing, beyond it."""
    lo = ratio / (2 - ratio)
    beyond = max(0.0, Q * (1 - ratio) - 1) * (1 / lo - 1)
    return F.floor(length * (1 - 2 * Q * (1 - ratio) - beyond) - (Q - 1) - 2 * beyond - 1e-6)


def pair_classes(ratio: float) -> list[tuple[int, int, str, int, int]]:
    """(left length, right length, way, left deletions, right deletions) of the
    lengths that can reach the ratio.  Two strings d inserts and deletes apart
    have a common subsequence left after i and j deletions, i + j = d and
    i - j the difference of their lengths.  ``delete``: few enough variants
    to store them all; ``gram``: a shared q-gram is certain; ``all``: neither."""
    out = []
    lo = ratio / (2 - ratio)
    certain = {n: _min_shared_grams(n, ratio) for n in range(1, int(MOST_LENGTH / lo) + 3)}
    for la in range(1, MOST_LENGTH + 1):
        for lb in range(max(1, math.floor(la * lo) - 1), min(MOST_LENGTH, math.ceil(la / lo) + 1) + 1):
            k, apart = int((1 - ratio) * (la + lb) + 1e-9), la - lb
            if abs(apart) > k:
                continue
            d = k - (k - apart) % 2
            i, j = (d + apart) // 2, (d - apart) // 2
            i, j = (i, j) if i <= la else (la, lb)
            few = max(i, j) <= MOST_DELETIONS and max(math.comb(la, i), math.comb(lb, j)) <= MOST_VARIANTS
            way = "delete" if few else "gram" if min(certain[la], certain[lb]) >= 1 else "all"
            out.append((la, lb, way, i, j))
    return out


def _deletions(s: Column, n: int, begin=1) -> Column:
    """All strings left after n deletions (from place ``begin`` on)."""
    if not n:
        return F.array(s)
    first = F.lit(begin) if isinstance(begin, int) else begin
    places = F.when(F.length(s) >= first, F.sequence(first, F.length(s))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(places, lambda p: _deletions(F.concat(_part(s, 1, p - 1), _part(s, p + 1, F.length(s))), n - 1, p)))


def _variants(ids: DataFrame, name: str, n: str) -> DataFrame:
    """One row a variant of an id and pair of lengths; the key holds both lengths."""
    kept = F.array().cast("array<string>")
    for k in range(MOST_DELETIONS + 1):
        kept = F.when(F.col(n) == k, _deletions(F.col(name), k)).otherwise(kept)
    return ids.select(name, "_la", "_lb", F.explode(F.array_distinct(kept)).alias("_v")).select(
        name, F.xxhash64("_v", "_la", "_lb").alias("_key"))


def _grams(ids: DataFrame, name: str) -> DataFrame:
    """Q-grams of the ids, the n-th of equal ones as its own gram."""
    n = F.length(name)
    g = (ids.where(n >= Q).select(name, F.explode(F.sequence(F.lit(1), n - Q + 1)).alias("_s"))
         .select(name, F.substring(F.col(name), F.col("_s"), F.lit(Q)).alias("_g"), "_s"))
    nth = F.row_number().over(W.partitionBy(name, "_g").orderBy("_s"))
    return g.withColumn("_o", nth).select(name, F.concat("_g", F.lit("#"), F.col("_o").cast("string")).alias("_gram"))


def _rare_grams(ids: DataFrame, name: str, counts: DataFrame, ratio: float) -> DataFrame:
    """The rarest grams of an id, so many that any partner must share one."""
    n = F.length(name)
    certain = F.greatest(_shared_grams(n, ratio), F.lit(1))
    rank = F.row_number().over(W.partitionBy(name).orderBy("_f", "_gram"))
    return _grams(ids, name).join(counts, "_gram").withColumn("_rank", rank).where(F.col("_rank") <= n - Q + 1 - certain + 1).select(name, "_gram")


def similar_pairs(left: DataFrame, right: DataFrame, left_col: str, right_col: str, ratio: float) -> DataFrame:
    """Distinct pairs (left_col, right_col) of ids that may reach the ratio: all
    that do, and of the others only such as are within the budget by
    ``levenshtein``, which never exceeds the insert/delete distance.

    Pairs of short ids, or of few edits, meet on their deletion variants: ids of
    one template (a long common part and a number) meet only where they differ
    in so few characters, so candidates grow with the ids, not with their
    square.  Longer ones meet on (rare q-gram, length), and only pairs of
    lengths for which neither is certain (low ratios) meet on their lengths."""
    spark = left.sparkSession
    a = left.select(F.col(left_col).alias(left_col)).where(F.length(left_col) > 0).distinct()
    b = right.select(F.col(right_col).alias(right_col)).where(F.length(right_col) > 0).distinct()
    la, lb = F.length(left_col), F.length(right_col)
    classes = F.broadcast(spark.createDataFrame(pair_classes(ratio), "_la int, _lb int, _way string, _i int, _j int"))   # lengths to 256
    ac, bc = a.withColumn("_la", la).join(classes, "_la"), b.withColumn("_lb", lb).join(classes, "_lb")
    of = lambda df, way: df.where(F.col("_way") == way)
    found = _variants(of(ac, "delete"), left_col, "_i").join(_variants(of(bc, "delete"), right_col, "_j"), "_key").select(left_col, right_col)

    lo = ratio / (2 - ratio)
    long_a, long_b = a.where(la > int(MOST_LENGTH * lo) - 1), b.where(lb > int(MOST_LENGTH * lo) - 1)
    slow_a = of(ac, "gram").select(left_col).distinct().unionByName(long_a).distinct()
    slow_b = of(bc, "gram").select(right_col).distinct().unionByName(long_b).distinct()
    counts = (_grams(slow_a, left_col).select("_gram").unionAll(_grams(slow_b, right_col).select("_gram"))
              .groupBy("_gram").agg(F.count(F.lit(1)).alias("_f")))
    rare_a, rare_b = _rare_grams(slow_a, left_col, counts, ratio), _rare_grams(slow_b, right_col, counts, ratio)
    by_gram = (rare_a.join(of(ac, "gram").select(left_col, "_lb"), left_col)
               .join(rare_b.withColumn("_lb", lb), ["_gram", "_lb"]).select(left_col, right_col))
    # beyond the table of lengths: bands of the logarithm, partners are in the same or the next one
    width = -math.log(lo) * (1 + 1e-9)
    band = lambda n: F.floor(F.log(n.cast("double")) / F.lit(width)).cast("int")
    by_band = (rare_a.join(long_a, left_col).withColumn("_b", F.explode(F.array(*[band(la) + d for d in (-1, 0, 1)])))
               .join(rare_b.join(long_b, right_col).withColumn("_b", band(lb)), ["_gram", "_b"])
               .where(F.greatest(la, lb) > MOST_LENGTH).select(left_col, right_col))
    found = found.unionAll(by_gram).unionAll(by_band)
    if any(c[2] == "all" for c in pair_classes(ratio)):
        found = found.unionAll(of(ac, "all").select(left_col, "_lb").join(b.withColumn("_lb", lb), "_lb").select(left_col, right_col))
    if _min_shared_grams(MOST_LENGTH, ratio) < 1:       # no gram is certain for long ids either
        found = found.unionAll(long_a.withColumn("_b", F.explode(F.array(*[band(la) + d for d in (-1, 0, 1)])))
                               .join(long_b.withColumn("_b", band(lb)), "_b")
                               .where(F.greatest(la, lb) > MOST_LENGTH).select(left_col, right_col))
    return (found.distinct()
            .where(F.levenshtein(left_col, right_col) <= budget_of(la, lb, ratio)))
