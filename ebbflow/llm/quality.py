"""Quality classifier that compresses.

Two zstandard dictionaries are trained, one from good and one from bad labelled
text.  A text is compressed with either; how much smaller it gets with the good
one, relative to its size, is the evidence, which a logistic fit on labelled
rows that the dictionaries have not seen turns into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Model:
    """Dictionaries and the calibration's weights (a few hundred KB)."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]      # of the scaled evidence, then the intercept
    level: int
    block: int


class _Scorer:
    """Compressors of a model; made once in a Python worker."""

    def __init__(self, good: bytes, bad: bytes, level: int, block: int):
        def compressor(d: bytes):
            if not d:
                return zstandard.ZstdCompressor(level=level, write_content_size=False)
            zd = zstandard.ZstdCompressionDict(d)
            zd.precompute_compress(level)
            return zstandard.ZstdCompressor(level=level, dict_data=zd, write_content_size=False,
                                            write_checksum=False, write_dict_id=False)
        self.good, self.bad, self.block = compressor(good), compressor(bad), block
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Normalised size difference, its saturated count of bytes, and the
        text's own compressed share (repetition).  Blocks keep a long text
        from being its own dictionary; all of the text is compressed."""
        b = (text or "").encode("utf-8", "replace")
        g = w = 0
        for i in range(0, len(b), self.block):
            part = b[i:i + self.block]
            g += len(self.good.compress(part))
            w += len(self.bad.compress(part))
        own = min(1.0, len(self.plain.compress(b)) / len(b)) if b else 1.0
        return (w - g) / max(w, g, 1), float(np.tanh((w - g) / 50)), own


def _dictionary(texts: list[str], size: int, slice_bytes: int, slices: int, level: int) -> bytes:
    """A trained dictionary; empty if there is too little text to train on."""
    parts = []
    for t in texts:
        b = t.encode("utf-8", "replace")
        step = max(slice_bytes, len(b) // slices)       # slices spread over the whole text
        parts += [b[i:i + slice_bytes] for i in range(0, len(b), step)][:slices]
    try:
        return zstandard.train_dictionary(size, parts, level=level).as_bytes()
    except zstandard.ZstdError:
        return b""


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton's method (last: intercept)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int,
                    usable: Column | None = None) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Up to ``per_class`` labelled texts of either class, in the order of a
    hash of the id, and how many labels of each class there are in all.  Ids
    without a label, or with two, are not used.  The ids are chosen from the
    narrow label table; only the chosen texts move."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if usable is not None:
        rows = rows.where(usable)
    one = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y")
    all_ = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    ids = None
    for y in (0, 1):
        part = one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionAll(part)
    chosen = {r["doc_id"]: r["y"] for r in ids.select("doc_id", "y").collect()}      # at most 2 * per_class
    if not chosen:
        return [], all_
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(k,) for k in chosen], T.StructType([T.StructField("doc_id", T.LongType())]))
    got = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
           .join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").collect())
    return [(r["text"], chosen[r["doc_id"]]) for r in got], all_


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500,
        usable: Column | None = None, dictionary_bytes: int = 112_640, level: int = 3,
        block: int = 2048) -> Model:
    """The model of a bounded sample: at most ``per_class`` rows of either
    label.  Six tenths train the dictionaries, the rest the calibration, whose
    intercept is then moved from the sample's share of good rows to that of all
    labels, so that the bound does not shift the scores.  With
    one class, or nothing, to learn from, scores are the share of good rows
    (one half without labels)."""
    sample, all_ = labelled_sample(docs, labels, label, per_class, usable)
    by = {y: [t for t, k in sample if k == y] for y in (0, 1)}
    cut = {y: len(by[y]) * 6 // 10 for y in (0, 1)}
    good, bad = (_dictionary(by[y][:cut[y]], dictionary_bytes, 2000, 8, level) for y in (1, 0))
    rest = [(t, y) for y in (0, 1) for t in by[y][cut[y]:]]
    y = np.array([k for _, k in rest], float)
    if not rest or y.min() == y.max() or not good or not bad:
        n = len(sample)
        share = (len(by[1]) + 1) / (n + 2)
        return Model(good, bad, (0.0, 0.0, 0.0, float(np.log(share / (1 - share)))), level, block)
    scorer = _Scorer(good, bad, level, block)
    x = np.array([scorer.evidence(t) for t, _ in rest])
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    w = _logistic(x / scale, y)
    prior = np.log(all_[1] / all_[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, (*(float(v) for v in w[:-1] / scale), float(w[-1] + prior)), level, block)


def score(text: Column, model: Model) -> Column:
    """Probability (0 to 1) that the whole text is good; null counts as empty."""
    good, bad, weights, level, block = model.good, model.bad, model.weights, model.level, model.block
    made: list[_Scorer] = []

    @F.pandas_udf(T.DoubleType())
    def udf(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(_Scorer(good, bad, level, block))
        x = np.array([made[0].evidence(t) for t in texts]).reshape(-1, 3)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(weights[:3]) + weights[3], -30, 30))))
    return udf(text)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 3, is 1
    (false for a null id, which has no label either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row.
    Repeated rows get equal scores; null and empty texts the calibrated score
    of no evidence.  Only columns doc_id and text of ``docs`` are read."""
    model = fit(docs, labels, usable=~held_out(F.col("doc_id")), **options)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))
