"""Hard negatives by an inverted multi-index.

The components are split in two halves, each with a codebook of its own
(k-means on a bounded sample); every row belongs to the cell of its two nearest
codes.  For an anchor x, no row of the cell (i, j) scores more than
b1[i] + b2[j], where b[i] = x.c[i] + |x| r[i] over the half's components, code
c[i] and radius r[i], the largest distance of a row to its code.  A heap visits
cells by falling bound (multi-sequence order).

Anchors ask in two rounds: first for the leading cells, until these hold
``first_rows`` rows; what is found there gives a score that the answer is certain
to reach, and the second round asks for the further cells up to the first one
whose bound is below it.  The results are exact whatever the codebooks are; the
bounds only decide how many cells are read.  Positives are searched first, then
negatives within the windows that the positives' scores set.

A cell's rows are dealt out in chunks of about ``chunk`` rows and anchors in
blocks of about ``block``, so one vector that holds a third of all rows fills chunks, not
one task; a task works on one chunk and one block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Rows that the codebooks are fitted on, rows that a cell holds on average, codes of a half at most (their cells are counted on the driver).
SAMPLE, CELL_ROWS, MAX_CODES = 8_192, 1_024, 512
CHUNK, BLOCK, FIRST_ROWS = 8_192, 2_048, 4_096
#: Scores that a long cannot hold stop at these.
LOW, HIGH = -(2 ** 63) + 1, 2 ** 63 - 1


@dataclass(frozen=True)
class Index:
    """Codebooks (scaled components), radii of the codes and rows of each cell;
    rows of a chunk and rows that the first round asks for."""

    width: int
    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    chunk: int
    first_rows: int

    def chunks(self) -> np.ndarray:
        return -(-self.rows // self.chunk)


def matrix(vectors: pa.Array, width: int, scale: float) -> np.ndarray:
    """Rows of floor(scale * component), as whole numbers in doubles; missing
    components at the end of shorter vectors count 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width))
    with np.errstate(over="ignore"):
        out[np.arange(width) < size[:, None]] = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False))
    return out


def codebook(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k codes by Lloyd's algorithm from evenly spaced distinct points."""
    points = np.clip(points, -1e100, 1e100)
    distinct = np.unique(points, axis=0)
    codes = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(rounds):
        near, _ = nearest(points, codes)
        total = np.zeros_like(codes)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=len(codes))[:, None]
        codes = np.where(count > 0, total / np.maximum(count, 1), codes)
    return codes


def nearest(points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each point and the distance to it (infinite where it overflows)."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.nan_to_num((codes * codes).sum(axis=1) - 2 * points @ codes.T, nan=0.0).argmin(axis=1)
        return near, np.nan_to_num(np.sqrt(((points - codes[near]) ** 2).sum(axis=1)), nan=np.inf)


def visits(index: Index, x: np.ndarray) -> Iterator[tuple[float, int]]:
    """(bound, cell) of the cells that have rows, by falling bound."""
    half = index.width // 2
    bounds = []
    for part, codes, radii in zip((x[:half], x[half:]), index.codes, index.radii):
        with np.errstate(over="ignore", invalid="ignore"):
            norm = math.sqrt(min(float(part @ part), 1e300))
            b = codes @ part + norm * radii
            b += 1e-9 * (norm * (np.sqrt((codes * codes).sum(axis=1)) + radii) + 1)      # rounding
        bounds.append(np.where(norm == 0, 1e-9, np.nan_to_num(b, nan=np.inf, posinf=np.inf)))
    (first, second), k = bounds, len(index.codes[1])
    by_first, by_second = np.argsort(-first), np.argsort(-second)
    first, second = first[by_first].tolist(), second[by_second].tolist()
    by_first, by_second, rows = by_first.tolist(), by_second.tolist(), index.rows
    heap = [(-(first[0] + second[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        cell = by_first[i] * k + by_second[j]
        if rows[cell]:
            yield -bound, cell
        if j + 1 < len(second):
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as longs."""
    safe = math.sqrt(2 ** 53 / max(1, a.shape[1]))
    wide_a, wide_b = (np.flatnonzero(np.abs(m).max(axis=1, initial=0) > safe) for m in (a, b))
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.clip(np.nan_to_num(a @ b.T), -2.0 ** 62, 2.0 ** 62).astype(np.int64)
    whole = lambda m: [[int(x) for x in row] for row in m]
    exact = lambda m, n: np.array([[min(max(sum(map(mul, p, q)), LOW), HIGH) for q in whole(n)] for p in whole(m)], np.int64)
    if len(wide_a):
        out[wide_a] = exact(a[wide_a], b)
    if len(wide_b):
        out[:, wide_b] = exact(b[wide_b], a).T
    return out


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _prepared(vectors: DataFrame, anchor: Callable[[Column], Column], scale: float) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < F.lit(float("inf"))))
    return settled(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"),
                                  F.coalesce(anchor(F.col("vec_id")), F.lit(False)).alias("asks"))
                   .where(F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
                   .withColumn("row", F.monotonically_increasing_id()))


def _indexed(rows: DataFrame, scale: float, cell_rows: int, chunk: int, first_rows: int) -> tuple[DataFrame, Index, int] | None:
    """Rows with their cells, the index and the number of anchors; None without anchors."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.count_if("asks").alias("asks")).first()
    if not total["asks"]:
        return None
    width = max(2, total["width"])
    k = min(MAX_CODES, max(1, math.ceil(math.sqrt(total["n"] / cell_rows))))
    sample = matrix(rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("x").toArrow()["x"], width, scale)
    codes = codebook(sample[:, :width // 2], k), codebook(sample[:, width // 2:], k)

    def assign(batches):
        for batch in batches:
            m = matrix(batch.column("x"), width, scale)
            (i, d), (j, e) = nearest(m[:, :width // 2], codes[0]), nearest(m[:, width // 2:], codes[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i * len(codes[1]) + j, pa.int32()), pa.array(d), pa.array(e)],
                                             [*batch.schema.names, "cell", "d1", "d2"])

    schema = "vec_id bigint, label bigint, x array<double>, asks boolean, row bigint, cell int, d1 double, d2 double"
    placed = settled(rows.mapInArrow(assign, schema))
    count = np.zeros(len(codes[0]) * len(codes[1]), np.int64)
    radii = np.zeros(len(codes[0])), np.zeros(len(codes[1]))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect():
        count[r["cell"]] = r["n"]                       # one row a cell
        for radius, at, d in zip(radii, divmod(r["cell"], len(codes[1])), (r["d1"], r["d2"])):
            radius[at] = max(radius[at], d)
    return placed, Index(width, codes, radii, count, chunk, first_rows), total["asks"]


def _requests(anchors: DataFrame, index: Index, scale: float, further: bool) -> DataFrame:
    """Rows (cell, chunk) x anchor.  The first round asks for the leading cells
    with ``first_rows`` rows; the further one for the cells after these whose bound
    reaches the anchor's ``least``."""
    def ask(batches):
        chunks = index.chunks()
        for batch in batches:
            least = batch.column("least").to_pylist()
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                who, cell, chunk = [], [], []
                for a, x in enumerate(matrix(part.column("x"), index.width, scale)):
                    have = 0
                    for bound, c in visits(index, x):
                        leading = have < index.first_rows
                        have += int(index.rows[c])
                        if leading == further:
                            if leading:
                                continue
                            break
                        if further and bound < least[s + a]:
                            break
                        n = int(chunks[c])
                        who += [a] * n
                        cell += [c] * n
                        chunk += range(n)
                taken = part.take(pa.array(who, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array(chunk, pa.int32())],
                                                 [*taken.schema.names, "cell", "chunk"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(ask, f"{schema}, cell int, chunk int")


def _answers(placed: DataFrame, asked: DataFrame, index: Index, scale: float, pick: Callable) -> DataFrame:
    """anchor, slot, id, score, row: what ``pick`` takes from each chunk for each anchor that asks for it."""
    chunks = placed.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(index.chunks()) if n], "cell int, chunks int")
    keys = ["cell", "chunk", "block"]
    rows = (placed.join(F.broadcast(chunks), "cell")    # one row a cell: bounded by the codebooks
            .withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
            .join(asked.select(keys).distinct(), ["cell", "chunk"])
            .select(*(F.col(c).alias(f"{c}_") for c in keys), "row", "vec_id", "label", "x"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            right = right.sort_by([("vec_id", "ascending"), ("row", "ascending")])       # null ids last
            m, label, row = matrix(right["x"], index.width, scale), right["label"].to_numpy(), right["row"].to_numpy()
            ids = right["vec_id"].to_pylist()
            asks = left.to_pylist()
            q = matrix(left["x"], index.width, scale)
            for s in range(0, len(asks), 256):
                for ask, scores in zip(asks[s:s + 256], products(q[s:s + 256], m)):
                    for slot, at in pick(ask, scores, label, row):
                        for k in at.tolist():
                            for out, v in zip(found, (ask["anchor"], slot, ids[k], int(scores[k]), int(row[k]))):
                                out.append(v)
        return pa.table([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(found)], ["anchor", "slot", "id", "score", "row"])

    return asked.groupBy(keys).cogroup(rows.groupBy([f"{c}_" for c in keys])).applyInArrow(
        run, "anchor bigint, slot int, id bigint, score bigint, row bigint")


def _leading(scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The first n of the places ``at`` by falling score, then place (places are in the order of the ids)."""
    if len(at) > n:
        least = np.partition(scores[at], len(at) - n)[len(at) - n]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")][:n]


def _best(answers: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _two_rounds(placed: DataFrame, anchors: DataFrame, index: Index, scale: float, pick: Callable, n: int,
                certain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best n answers of every anchor and slot.  ``certain`` gives
    (anchor, least): the score that further answers must reach."""
    first = settled(_best(_answers(placed, settled(_requests(anchors, index, scale, False)), index, scale, pick), n))
    rest = anchors.drop("least").join(certain(first), "anchor", "left").fillna({"least": float("-inf")})
    more = _answers(placed, settled(_requests(rest.select(anchors.columns), index, scale, True)), index, scale, pick)
    return settled(_best(first.select(more.columns).unionAll(more), n))


def mine(vectors: DataFrame, anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, scale: float = 256.0,
         cell_rows: int = CELL_ROWS, chunk: int = CHUNK, block: int = BLOCK, first_rows: int = FIRST_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; a component x counts
    floor(scale * x) and a score is the inner product (beyond a long's range it
    stays at its end).  The rows whose vec_id fulfils ``anchor`` ask: their
    positives are the best other rows of their label, and of each positive the
    negatives are the best rows of other labels whose hundredfold score lies
    between low and high times the positive's.  Higher scores come first, ties
    by vec_id, null last.

    Rows with a null label, a null vector or a null or non-finite component (or
    one that scaling makes infinite) take no part.  Null ids are never anchors
    but may be found.  Rows that repeat are rows of their own: each copy of an
    anchor asks, and finds the other copies.  Components that shorter vectors
    lack count 0.  An empty table, or one without anchors, gives an empty
    result.  Other columns are not read, whatever their names."""
    rows = _prepared(vectors, anchor, scale)
    built = _indexed(rows, scale, cell_rows, chunk, first_rows)
    if built is None:
        return vectors.sparkSession.createDataFrame(
            [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    placed, index, asks = built
    blocks = math.ceil(asks / block)
    anchors = placed.where("asks").select(
        F.col("row").alias("anchor"), F.col("label").alias("own"), "x",
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0.0).alias("least"))

    def same(ask, scores, label, row):
        yield 0, _leading(scores, np.flatnonzero((label == ask["own"]) & (row != ask["anchor"])), positives)

    def reached(found):
        return (found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
                .where(F.col("n") >= positives).select("anchor", "least"))

    held = _two_rounds(placed, anchors, index, scale, same, positives, reached)
    windows = held.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("windows"))
    asking = anchors.join(windows, "anchor").select(*anchors.columns, "windows")

    def within(ask, scores, label, row):
        at = np.flatnonzero(label != ask["own"])
        spans = [(w["rank"], *window_of(w["score"], low, high)) for w in ask["windows"]]
        spans = [w for w in spans if w[1] <= w[2]]
        if not spans or not len(at):
            return
        at = at[(scores[at] >= min(w[1] for w in spans)) & (scores[at] <= max(w[2] for w in spans))]
        at = at[np.argsort(-scores[at], kind="stable")]
        falling = -scores[at]
        for rank, least, most in spans:
            begin = int(np.searchsorted(falling, -most, "left"))
            end = min(begin + negatives, int(np.searchsorted(falling, -least, "right")))
            if begin < end:
                yield rank, at[begin:end]

    def filled(found):
        """The least score that matters for any window: that of its last place, or the window's end while places are free."""
        last = found.groupBy("anchor", F.col("slot").alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
        p = F.col("score").cast("decimal(38,0)")
        end = F.ceil(p * low / 100).cast("double") - F.abs(F.col("score").cast("double")) * 1e-12       # rounded downwards
        return (held.select("anchor", "rank", "score", "row").join(last, ["anchor", "rank"], "left")
                .where(p * low <= p * high)
                .groupBy("anchor").agg(F.min(F.when(F.col("n") >= negatives, F.col("s").cast("double")).otherwise(end)).alias("least")))

    def open_or_none(found):
        """Anchors without a window ask no further."""
        return asking.select("anchor").join(filled(found), "anchor", "left").fillna({"least": float("inf")})

    chosen = _two_rounds(placed, asking, index, scale, within, negatives, open_or_none)
    ids = placed.where("asks").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (chosen.select("anchor", F.col("slot"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(held.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                  ["anchor", "slot"])
            .join(ids, "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) AS slot FROM s WHERE same) t WHERE slot <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.slot ORDER BY s.score DESC, s.id, s.br) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
