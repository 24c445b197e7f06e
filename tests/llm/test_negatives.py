"""Hard negatives against brute force in whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.llm import negatives as N

from .conftest import clashing

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("label", T.IntegerType())])


def brute(rows, step=50, positives=5, negatives=3):
    part = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda i: (i is None, i)
    out = []
    for a, (i, v, lab) in enumerate(part):
        if i is None or i % step:
            continue
        scored = [(-min(max(sum(x * y for x, y in zip(v, w)), N.LOW), N.HIGH), first(j), own == lab) for b, (j, w, own) in enumerate(part) if b != a]
        for p, pid, _ in sorted(s for s in scored if s[2])[:positives]:
            fit = sorted(s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            out += [(i, pid[1], k, nid[1], -p, -n) for k, (n, nid, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows, step=50, **more):
    df = clashing(spark.createDataFrame(rows, SCHEMA)).withColumn("anchor", F.lit("x")).withColumn("cell", F.lit("y"))
    return sorted((tuple(r) for r in N.mine(df, lambda i: i % step == 0, **more).collect()), key=str)


def clustered(rng, n, width=6, spread=0.3):
    centres = rng.normal(size=(7, width))
    return [(i, (centres[rng.integers(7)] + spread * rng.normal(size=width)).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_many_cells_and_rounds(spark, seed):
    """Cells of few rows and short first rounds, so that both rounds and the bounds decide."""
    rng = np.random.default_rng(seed)
    rows = clustered(rng, 400, spread=0.2)
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(150)]           # one vector of a third of all rows
    got = mined(spark, rows, step=20, cell_rows=12, chunk=16, block=8, first_rows=20)
    assert got == brute(rows, step=20) and got


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.25, 0.1, 0.0], 1), (0, [0.5, 0.25, 0.1, 0.0], 1), (50, None, 1), (100, [0.1, None, 0.2, 0.3], 1),
            (150, [nan, 0.1, 0.1, 0.1], 2), (200, [inf, 0.1, 0.1, 0.1], 2), (250, [0.3, 0.3, 0.3, 0.3], None), (300, [], 1),
            (350, [0.4, 0.3], 1), (None, [0.5, 0.2, 0.1, 0.1], 1), (None, [0.4, 0.2, 0.0, 0.1], 2), (-50, [-0.5, 0.2, 0.3, 0.1], 2)]
    rng = random.Random(4)
    rows += [(i, [rng.uniform(-0.2, 0.6) for _ in range(4)], rng.randrange(3)) for i in range(400, 480)]
    assert mined(spark, rows) == brute(rows) != []


def test_ties_go_to_smaller_ids(spark):
    rows = [(0, [1.0, 0.0], 1), (9, [0.8, 0.1], 1), (7, [0.8, 0.2], 1)] + [(i, [0.5, float(i % 2)], 2) for i in range(60, 90)]
    got = mined(spark, rows)
    assert [r[:4] for r in got if r[1] == 7] == [(0, 7, 1, 60), (0, 7, 2, 61), (0, 7, 3, 62)]
    assert got == brute(rows)


def test_large_components(spark):
    rows = [(0, [1e5, 3e9 + 0.5], 1), (1, [2e5, 3e9], 1), (2, [1.0, 2.5e9], 2), (3, [7.0, 1.6e9], 2)]
    rows += [(i, [float(i), 1.0], i % 3) for i in range(4, 30)]
    assert mined(spark, rows) == brute(rows)            # scores beyond a long stay at its end
    exact = [(i, [x / 1e4 for x in v], lab) for i, v, lab in rows]
    assert mined(spark, exact) == brute(exact) != []


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [0.7], 2)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_cells_come_by_falling_bound_and_hold_it():
    rng = np.random.default_rng(5)
    points = np.floor(256 * rng.normal(size=(300, 8)))
    codes = N.codebook(points[:, :4], 6), N.codebook(points[:, 4:], 5)
    (i, d), (j, e) = N.nearest(points[:, :4], codes[0]), N.nearest(points[:, 4:], codes[1])
    radii = tuple(np.array([x[at == c].max(initial=0) for c in range(n)]) for at, x, n in ((i, d, 6), (j, e, 5)))
    cell = i * 5 + j
    index = N.Index(8, codes, radii, np.bincount(cell, minlength=30), 10, 10)
    for x in points[:40]:
        seen = list(N.visits(index, x))
        assert [b for b, _ in seen] == sorted((b for b, _ in seen), reverse=True)
        assert sorted(c for _, c in seen) == sorted(set(cell.tolist()))
        for bound, c in seen:
            assert (points[cell == c] @ x).max() <= bound
