"""Runs of words and collapsed texts against brute force."""

import hashlib
import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbflow.llm import repeats as R

from .conftest import clashing, make_docs


def brute(w):
    """All runs, by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // R.MIN_TURNS + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(R.MIN_WORDS, R.MIN_TURNS * q) and not any(w[s:e - d] == w[s + d:e] for d in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def brute_planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=4), st.integers(1, 9), st.integers(2, 9))
def test_runs_of_small_alphabets(texts, size, turns):
    texts = [t + t[:size] * turns + t for t in texts]
    assert R.runs_of_texts(texts) == [brute(t) for t in texts]


def test_runs_of_random_texts():
    rng = random.Random(3)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 12)):
            w = [b"w%d" % rng.randrange(rng.choice([1, 2, 4, 300])) for _ in range(rng.randint(0, 150))]
            a = rng.randrange(len(w) + 1)
            turn = w[a:a + 1 + (len(w) - a) // rng.randint(3, 10)]
            w = w[:a] + (turn * 200)[:len(w) - a]
            texts.append(w + [b"w%d" % rng.randrange(5) for _ in range(rng.randint(0, 9))])
        assert R.runs_of_texts(texts) == [brute(t) for t in texts]


def test_the_tree_answers_common_prefixes():
    rng = random.Random(11)
    for size in (1, 2, 3, 40, 200):
        w = [rng.randint(1, 3) for _ in range(size)]
        tree = R.SuffixTree(w)
        order = sorted(range(size), key=lambda i: w[i:])
        # the mark at the end sorts first, as the end of a list does
        assert np.argsort(tree.place[:size]).tolist() == order
        pairs = [(i, j) for i in range(size) for j in range(size) if i != j][:4000]
        if pairs:
            a, b = map(np.array, zip(*pairs))
            got = tree.common(a, b)
            for (i, j), n in zip(pairs, got.tolist()):
                assert w[i:i + n] == w[j:j + n] and (max(i, j) + n == size or w[i + n] != w[j + n])


def test_known_runs():
    assert R.runs_of_texts([b"x a a a a a a y".split()]) == [[(1, 6, 1)]]
    assert R.runs_of_texts([b"a a a a a".split()]) == [[]]                        # under six words
    assert R.runs_of_texts([b"a b a b a b a c".split()]) == [[]]                  # under four turns
    assert R.runs_of_texts([b"c a b a b a b a b a c".split()]) == [[(1, 9, 2)]]
    assert R.strongest([(5, 9, 2), (0, 18, 4), (30, 9, 2)]) == (0, 18, 4)         # equal exponents: the first
    assert R.strongest([]) is None


def test_report_against_brute_force(spark, odd, odd_rows):
    rows = [r for r in odd_rows if r[1] is None or len(r[1]) < 10_000]
    rows += [(i, " ".join(f"w{(i * j) % 97}" for j in range(90)), "a") for i in range(100, 160)]
    docs = clashing(make_docs(spark, rows))
    got = sorted(map(tuple, R.report(docs, R.planted).collect()), key=str)
    expected, ends = [], 0
    for i, text, _ in rows:
        w = (text or "").encode().split()
        w = w if i is None else brute_planted(i, w)
        runs = brute(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        ends += bool(runs)
        expected.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                         hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                         hashlib.sha256(b" ".join(brute_kept(w, runs))).hexdigest()))
    assert ends > 3
    assert got == sorted(expected, key=str)


def test_find_gives_runs_and_texts(spark):
    docs = make_docs(spark, [(1, "go  on\tand on and on and on and on now", "a"), (1, None, "a"), (None, " x", "b")])
    got = sorted(map(tuple, R.find(docs).collect()), key=str)
    assert [(i, [tuple(r) for r in runs], text) for i, runs, text in got] == [
        (1, [(1, 9, 2)], "go on and now"), (1, [], ""), (None, [], " x")]


def test_empty_table(spark, empty):
    assert R.report(empty, R.planted).collect() == [] and R.find(empty).collect() == []


def test_very_long_text():
    rng = random.Random(2)
    turn = [b"w%d" % rng.randrange(50) for _ in range(30_000)]
    text = [b"w%d" % rng.randrange(5000) for _ in range(100_000)] + turn * 4
    t = time.time()
    runs = R.runs_of_texts([text])[0]
    assert time.time() - t < 60
    assert max(runs, key=lambda r: r[1])[1:] in {(120_000, 30_000), (120_001, 30_000)}
