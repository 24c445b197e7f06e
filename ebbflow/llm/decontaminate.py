"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may appear in a document with up to
k = floor(rate * n) edits.  Cut into k + 1 pieces, at least one piece must then
stand in the document unchanged.  An Aho-Corasick automaton finds the pieces;
around each hit the item is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import bisect
import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HITS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()),
    T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_WORDS = re.compile(r"\S+")


def normal(text: str) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split())


def substring_distance(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any substring of ``text`` and the
    first end of such a substring (Myers 1999, one integer as bit vector)."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full         # a match may begin anywhere: no carry comes in
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """Pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.auto, pieces = [], ahocorasick.Automaton(), {}
        for item_id, text in items:
            item = normal(text or "")
            if not item:
                continue
            n, k = len(item), int(rate * len(item))
            self.items.append((item_id, item, k))
            for p in range(k + 1):
                lo, hi = n * p // (k + 1), n * (p + 1) // (k + 1)
                pieces.setdefault(item[lo:hi], []).append((len(self.items) - 1, lo))
        for piece, where in pieces.items():
            self.auto.add_word(piece, (len(piece), where))
        if pieces:
            self.auto.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, begin, end) of the best place of every item found;
        begin and end are characters of the given text."""
        if not text or not self.items:
            return []
        norm = normal(text)
        at: dict[int, set[int]] = {}
        for end, (n, where) in self.auto.iter(norm):
            for item, lo in where:
                at.setdefault(item, set()).add(end - n + 1 - lo)        # where the item would begin
        found = []
        for i, starts in at.items():
            item_id, item, k = self.items[i]
            best = None
            lo = hi = None
            spans = []
            for s in sorted(starts):        # windows that overlap are verified once
                a, b = max(0, s - k), s + len(item) + k
                if lo is not None and a <= hi:
                    hi = max(hi, b)
                else:
                    if lo is not None:
                        spans.append((lo, hi))
                    lo, hi = a, b
            spans.append((lo, hi))
            for a, b in spans:
                edits, end = substring_distance(item, norm[a:b])
                if edits <= k and (best is None or edits < best[0]):
                    back, length = substring_distance(item[::-1], norm[max(0, a + end - len(item) - k):a + end][::-1])
                    best = (edits, a + end - (length if back == edits else len(item)), a + end)
            if best:
                found.append((item_id, best[0], best[1], best[2]))
        if not found:
            return []
        starts, begins, pos = [], [], 0         # normalised word starts against those in the text
        lengths = []
        for m in _WORDS.finditer(text):
            w = m.group().lower()
            starts.append(pos)
            begins.append(m.start())
            lengths.append(m.end() - m.start())
            pos += len(w) + 1

        def source(p: int, last: bool) -> int:
            j = max(0, bisect.bisect_right(starts, p - last) - 1)
            return begins[j] + min(lengths[j], p - starts[j])
        return sorted((i, e, source(max(b, 0), False), source(t, True)) for i, e, b, t in found)


def _blocks(benchmark: DataFrame, block_chars: int):
    """Items in blocks of about ``block_chars`` characters, one at a time."""
    rows = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
            .where("text is not null and trim(text) <> ''").distinct())
    total = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-total // block_chars)
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x))


def matches(text: Column, benchmark: DataFrame, rate: float = 0.07, block_chars: int = 16_000_000) -> Column:
    """Array of hits (item_id, edits, begin, end) of the text: the best place
    of every benchmark item that stands in it with at most ``rate`` edits a
    character.  The benchmark is a set of queries: it goes against all rows in
    blocks of bounded size, each broadcast on its own."""
    out = None
    for block in _blocks(benchmark, block_chars):
        found = _block_matches(benchmark.sparkSession.sparkContext.broadcast(block), rate)(text)
        out = found if out is None else F.concat(out, found)
    return F.array().cast(HITS) if out is None else out


def _block_matches(block, rate: float):
    """The function of one broadcast block; a worker builds its automaton once."""
    made: list[Matcher] = []

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Matcher(block.value, rate))
        return pd.Series([made[0].hits(t) for t in texts], dtype=object)
    return hits


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.07) -> DataFrame:
    """``doc_id``, ``item_id``, ``edits``, ``begin``, ``end`` for every
    document and item that it contains (repeated rows of documents repeat).

    Null and empty texts and items match nothing; an item listed under several
    ids is found under each.  Only columns doc_id and text are read."""
    return (docs.select("doc_id", F.explode(matches(F.col("text"), benchmark, rate)).alias("hit"))
            .select("doc_id", "hit.item_id", "hit.edits", "hit.begin", "hit.end"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.07) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item."""
    return docs.where(F.size(matches(docs["text"], benchmark, rate)) == 0)
