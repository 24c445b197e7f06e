"""Stupid-backoff scores of documents, computed with joins.

A word's score after the word before it is the count of the pair over the
count of the first word; a pair without other occurrences backs off to ALPHA
times the word's own share of the corpus.  An occurrence does not count itself
(leave one out), so text that occurs once backs off.  A document's first word
gets its own share.  Scores are summed as whole millionths of a nat.

Counts are tables dealt out by hash; each document's distinct pairs are dealt
out by the same hash, joined to their counts there and summed per document.  Two bounded sets keep the tables small and
even:
  * words with at least a share 2**-23 of the corpus (so at most 2**23 of them)
    get a short number; pairs of two such words travel as one number;
  * pairs with at least a share 2**-19 (so at most 2**20 candidates) are
    scored where they stand, so no pair is a hot key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbflow.operators.clean import running_offsets

from .common import settled
from .tokens import SPACE, U, portions, word_hashes

ALPHA = 0.4
COMMON = 2.0 ** -23         # least share of a numbered word
HEAVY = 2.0 ** -20          # least known share of a pair that may be heavy (all with twice that are found)
FLUSH = 4_000_000           # words counted at once
_SHIFT = 23                 # bits of a word's number
_HASH = np.int64(-2 ** 63)  # the sign tells a word's hash (negative) from its number
_START = -1                 # stands for the word before a document's first word


def _words(texts: pa.Array):
    """(first row, end row, hash, text number) per portion; hashes are negative, none is ``_START``."""
    for row, end, data, offsets in portions(texts):
        h, _, doc = word_hashes(data, offsets, SPACE)
        h = h.view(np.int64) | _HASH
        yield row, end, np.where(h == _START, _START - 1, h), doc


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first * np.int64(-7046029254386353131) + second


def _count_words(batches):
    """Of about FLUSH words at a time, kind 1: (word, count); kind 2: (hash of
    a pair, count) for pairs with a share of HEAVY or more in it.  Equal hashes
    of different pairs merely make both candidates."""
    for batch in batches:
        words, pairs, size = [], [], 0
        for _, end, h, doc in _words(batch.column("text")):
            words.append(h)
            same = doc[:-1] == doc[1:]
            pairs.append(_pair_hash(h[:-1][same], h[1:][same]))
            size += len(h)
            if size >= FLUSH or end == batch.num_rows:
                w, c = np.unique(np.concatenate(words), return_counts=True)
                yield _batch({"kind": np.ones(len(w), np.int32), "a": w, "c": c})
                p, c = np.unique(np.concatenate(pairs), return_counts=True)
                often = c >= max(2, HEAVY * size)
                yield _batch({"kind": np.full(often.sum(), 2, np.int32), "a": p[often], "c": c[often]})
                words, pairs, size = [], [], 0


def _place(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each x in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


class _Numbers:
    """Numbers and counts of the common words."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hash, self.number, self.count = hashes[order], numbers[order], counts[order]
        self.count_of = np.zeros(len(counts), np.int64)     # numbers run from 0 without gaps
        self.count_of[numbers] = counts

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table, and whether the word is there."""
        return _place(self.hash, h)


def _micro(x: np.ndarray) -> np.ndarray:
    return np.floor(np.log(x) * 1e6 + 0.5).astype(np.int64)


def _pair_rows(batch, numbers: _Numbers):
    """Per portion: rows of the batch, pair's places, whether both are common, words, text numbers, first words."""
    for row, end, h, doc in _words(batch.column("text")):
        uniq, back = np.unique(h, return_inverse=True)
        at, known = numbers.find(uniq)
        at, known = at[back], known[back]
        same = np.flatnonzero(doc[:-1] == doc[1:])
        first = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else same
        yield row, end, h, doc, at, known, same, first


def _heavy_counts(numbers_b, candidates_b):
    def run(batches):
        numbers, candidates = _Numbers(*numbers_b.value), candidates_b.value
        for batch in batches:
            got = []
            for _, _, h, _, at, known, same, _ in _pair_rows(batch, numbers):
                both = same[known[same] & known[same + 1]]
                both = both[_place(candidates, _pair_hash(h[both], h[both + 1]))[1]]
                got.append(numbers.number[at[both]] << _SHIFT | numbers.number[at[both + 1]])
            if got:
                k, c = np.unique(np.concatenate(got), return_counts=True)
                yield _batch({"k": k, "c": c})
    return run


def _common_pairs(numbers_b, heavy_b, total: int):
    """Rows (k, c) of a document's pairs of common words that are not heavy,
    and one row with a negative k for itself: c is its number of words, v the
    millionths of what is scored here (heavy pairs, a common first word)."""
    def run(batches):
        numbers, (heavy, heavy_c) = _Numbers(*numbers_b.value), heavy_b.value
        for batch in batches:
            ids, marks = batch.column("doc_id").cast(pa.int64()), np.asarray(batch.column("mark"))
            for row, end, _, doc, at, known, same, first in _pair_rows(batch, numbers):
                n = end - row
                all_words, here_v = np.bincount(doc, minlength=n), np.zeros(n, np.int64)
                f = first[known[first]]
                here_v[doc[f]] = _micro(np.maximum(numbers.count[at[f]] - 1, 0.5) / total)
                both = same[known[same] & known[same + 1]]
                key = numbers.number[at[both]] << _SHIFT | numbers.number[at[both + 1]]
                pair, c = np.unique(doc[both] << 2 * _SHIFT | key, return_counts=True)
                d, key = pair >> 2 * _SHIFT, pair & (1 << 2 * _SHIFT) - 1
                place, hit = _place(heavy, key)
                if hit.any():
                    before = numbers.count_of[key[hit] >> _SHIFT]
                    v = _micro((heavy_c[place[hit]] - 1) / (before - 1)) * c[hit]
                    np.add.at(here_v, d[hit], v)
                    d, key, c = d[~hit], key[~hit], c[~hit]
                rows = np.concatenate([d, np.arange(n)])
                own = -1 - (marks[row:end] & np.int64(2 ** 62 - 1))      # spreads the documents' own rows
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(row + rows)), pa.array(marks[row + rows]), pa.array(np.concatenate([key, own])),
                    pa.array(np.concatenate([c, all_words])), pa.array(np.concatenate([np.zeros(len(key), np.int64), here_v]))],
                    ["doc_id", "mark", "k", "c", "v"])
    return run


def _rare_pairs(numbers_b):
    """Rows (w1, w2, c) of a document's pairs with a word that is not common,
    each word as its number or else its hash; w1 is _START for such a first word."""
    def run(batches):
        numbers = _Numbers(*numbers_b.value)
        for batch in batches:
            ids, marks = batch.column("doc_id").cast(pa.int64()), np.asarray(batch.column("mark"))
            for row, _, h, doc, at, known, same, first in _pair_rows(batch, numbers):
                if known.any():
                    h = np.where(known, numbers.number[at], h)
                some = same[~(known[same] & known[same + 1])]
                f = first[~known[first]]
                d = np.concatenate([doc[some], doc[f]])
                w1 = np.concatenate([h[some], np.full(len(f), _START, np.int64)])
                w2 = np.concatenate([h[some + 1], h[f]])
                order = np.lexsort((w2, w1, d))
                d, w1, w2 = d[order], w1[order], w2[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])) if len(d) else order
                c = np.diff(np.append(new, len(d)))
                rows = row + d[new]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(marks[rows]), pa.array(w1[new]),
                                                  pa.array(w2[new]), pa.array(c)], ["doc_id", "mark", "w1", "w2", "c"])
    return run


def _nats(x: Column) -> Column:
    return F.floor(F.ln(x) * 1e6 + 0.5).cast("long")


def _back_off(count: Column, total: int) -> Column:
    return F.greatest(count - 1, F.lit(0.5)) / F.lit(float(total))


def stupid_backoff(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_backoff`` (words that backed off),
    ``score_micro`` (sum of natural logarithms in millionths) and ``score``
    (mean per word; null without words) for every row, with counts over all
    rows.  Null and empty texts have no words; repeated rows count as text and
    each get a row.  Only columns doc_id and text are read."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    # with its id, half a hash tells a row from others (of equal ids); without one, a whole hash
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    mark = F.when(F.col("doc_id").isNull(), mark).otherwise(mark.bitwiseAND(F.lit(2 ** 32 - 1).cast("long")))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"),
                       F.coalesce("text", F.lit("")).alias("text"))
    counted = settled(text.select("text").mapInArrow(_count_words, "kind int, a bigint, c bigint")
                      .groupBy("kind", "a").agg(F.sum("c").alias("c")))
    words = counted.where("kind = 1").select(F.col("a").alias("word"), F.col("c").alias("n"))
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = max(2, math.ceil(total * COMMON))
    common = settled(running_offsets(words.where(F.col("n") >= least).withColumn("one", F.lit(1).cast("long")), ["word"], "one")
                     .select("word", "n", F.col("_off").cast("long").alias("number")))
    got = common.toPandas()         # at most 1 / COMMON rows
    numbers = (got["word"].to_numpy(np.int64), got["number"].to_numpy(np.int64), got["n"].to_numpy(np.int64))
    numbers_b = sc.broadcast(numbers)
    cand = counted.where((F.col("kind") == 2) & (F.col("c") >= max(2, total * HEAVY))).select("a").toPandas()      # at most 1 / HEAVY rows
    cand_b = sc.broadcast(np.sort(cand["a"].to_numpy(np.int64)))
    heavy = (text.select("text").mapInArrow(_heavy_counts(numbers_b, cand_b), "k bigint, c bigint")
             .groupBy("k").agg(F.sum("c").alias("c")).toPandas().sort_values("k"))
    heavy_b = sc.broadcast((heavy["k"].to_numpy(np.int64), heavy["c"].to_numpy(np.int64)))

    # pairs of common words: one number.  Dealt out by its hash once; each part's counts are
    # joined to its rows in place, so the pairs do not move a second time for a table of their own
    found = text.mapInArrow(_common_pairs(numbers_b, heavy_b, total), "doc_id bigint, mark bigint, k bigint, c bigint, v bigint")
    pairs = found.withColumn("n", F.sum("c").over(W.partitionBy("k")))
    own = F.col("k") < 0
    hit = ~own & (F.col("n") > 1)
    asked = F.when(hit, F.call_function("shiftright", F.col("k"), F.lit(_SHIFT))).otherwise(F.col("k").bitwiseAND(F.lit((1 << _SHIFT) - 1).cast("long")))
    known = F.broadcast(common.select("number", F.col("n").alias("n_word")))
    pairs = pairs.withColumn("asked", asked).join(known, F.col("asked") == F.col("number"), "left")
    many = pairs.select("doc_id", "mark", F.when(own, F.col("c")).otherwise(0).cast("long").alias("words"), (F.when(own | hit, 0).otherwise(F.col("c"))).cast("long").alias("backed"), own.cast("long").alias("rows"),
                        F.when(own, F.col("v")).when(hit, F.col("c") * _nats((F.col("n") - 1) / (F.col("n_word") - 1)))
                        .otherwise(F.col("c") * _nats(alpha * _back_off(F.col("n_word"), total))).alias("v"))

    # pairs with a rare word
    found = text.mapInArrow(_rare_pairs(numbers_b), "doc_id bigint, mark bigint, w1 bigint, w2 bigint, c bigint")
    first = F.col("w1") == _START
    hit = ~first & (F.col("n") > 1)
    pairs = (found.withColumn("n", F.sum("c").over(W.partitionBy("w1", "w2")))
             .select("doc_id", "mark", "c", first.alias("first"), F.when(hit, F.col("n")).otherwise(0).alias("n"),
                     F.when(hit, F.col("w1")).otherwise(F.col("w2")).alias("asked")))
    # the asked word's count: of a common word from the broadcast, of a rare one from the count table
    numbered = pairs.where("asked >= 0").join(known, F.col("asked") == F.col("number")).drop("number")
    rare = pairs.where("asked < 0").join(words.withColumnsRenamed({"n": "n_word"}), F.col("asked") == F.col("word")).drop("word")
    hit = F.col("n") > 0
    few = numbered.unionByName(rare).select(
        "doc_id", "mark", F.lit(0).cast("long").alias("words"), F.when(F.col("first") | hit, 0).otherwise(F.col("c")).cast("long").alias("backed"),
        F.lit(0).cast("long").alias("rows"),
        (F.col("c") * F.when(hit, _nats((F.col("n") - 1) / (F.col("n_word") - 1)))
         .when(F.col("first"), _nats(_back_off(F.col("n_word"), total)))
         .otherwise(_nats(alpha * _back_off(F.col("n_word"), total)))).alias("v"))
    sums = many.unionByName(few).groupBy("doc_id", "mark").agg(*[F.sum(x).alias(x) for x in ("words", "backed", "rows", "v")])
    # rows that repeat both id and text share a group: its sums are whole multiples
    once = lambda x: F.expr(f"{x} div rows")
    return (sums.select("doc_id", once("words").alias("n_words"), once("backed").alias("n_backoff"), once("v").alias("score_micro"), "rows")
            .withColumn("score", F.when(F.col("n_words") > 0, F.col("score_micro") / F.col("n_words") / F.lit(1e6)))
            .select("doc_id", "n_words", "n_backoff", "score_micro", "score", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_"))
            .drop("_"))


#: The same in SQL (DuckDB) for the documents table.
LM_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
occ AS (SELECT r, unnest(ws) AS w2, unnest(list_concat([NULL], ws[:len(ws) - 1])) AS w1, unnest(range(len(ws))) AS i FROM docs WHERE len(ws) > 0),
uni AS (SELECT w2 AS w, count(*) AS n FROM occ GROUP BY 1),
total AS (SELECT count(*)::DOUBLE AS n FROM occ),
bi AS (SELECT w1, w2, count(*) AS n FROM occ WHERE i > 0 GROUP BY 1, 2),
scored AS (SELECT r, i, b.n > 1 AS hit,
    CASE WHEN i > 0 AND b.n > 1 THEN floor(ln((b.n - 1)::DOUBLE / (u1.n - 1)) * 1e6 + 0.5)
         ELSE floor(ln((CASE WHEN i > 0 THEN {ALPHA}::DOUBLE ELSE 1.0::DOUBLE END) * (greatest((u2.n - 1)::DOUBLE, 0.5::DOUBLE) / (SELECT n FROM total))) * 1e6 + 0.5) END::BIGINT AS v
    FROM occ LEFT JOIN bi b USING (w1, w2) LEFT JOIN uni u1 ON u1.w = w1 JOIN uni u2 ON u2.w = w2),
sums AS (SELECT r, count(*) AS n, sum((i > 0 AND NOT hit)::INT) AS backed, sum(v) AS v FROM scored GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(backed, 0)::BIGINT AS n_backoff, coalesce(v, 0)::BIGINT AS score_micro,
    CASE WHEN n > 0 THEN v::DOUBLE / n / 1e6::DOUBLE END AS score FROM docs LEFT JOIN sums USING (r)
"""
