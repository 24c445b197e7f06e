"""LM scores, mixing, quality, secrets and fingerprints against plain versions; the pipeline."""

import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ebbflow.llm import lm, minhash, mixing, quality, queries, secrets

from .conftest import clashing, make_docs, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        frame = df.toArrow()
        con.register(name, frame)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- LM scores
def test_lm_scores_against_sql(spark, odd):
    assert rows_of(lm.stupid_backoff(clashing(odd))) == run_sql(lm.LM_SQL, documents=odd)


def test_lm_scores_with_rare_words(spark, odd, monkeypatch):
    """High shares: most words are rare and many pairs are heavy."""
    monkeypatch.setattr(lm, "COMMON", 0.002)
    monkeypatch.setattr(lm, "HEAVY", 0.0005)
    assert rows_of(lm.stupid_backoff(odd)) == run_sql(lm.LM_SQL, documents=odd)


def test_lm_score_by_hand(spark):
    docs = make_docs(spark, [(1, "a b a b", "s"), (2, "a C", "s"), (3, None, "s")])
    got = {r["doc_id"]: r for r in lm.stupid_backoff(docs).collect()}
    n = 6       # a 3, b 2, c 1; pairs: a b 2, b a 1, a c 1
    micro = lambda x: math.floor(math.log(x) * 1e6 + 0.5)
    assert got[1]["score_micro"] == micro(2 / n) + 2 * micro(1 / 2) + micro(0.4 * (2 / n))
    assert got[2]["score_micro"] == micro(2 / n) + micro(0.4 * (0.5 / n))
    assert (got[1]["n_backoff"], got[2]["n_backoff"], got[3]["n_words"], got[3]["score"]) == (1, 1, 0, None)


def test_lm_empty(empty):
    assert lm.stupid_backoff(empty).count() == 0


# ---- mixing
def brute_targets(sizes, weights, budget):
    """Share by weight, cut at twice the size, reshare until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done = {}
    while True:
        open_ = [s for s in names if s not in done]
        left, total = budget - sum(done.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * left / total > 2 * sizes[s]]
        if not over:
            return done | {s: weight[s] * left / total for s in open_}
        done |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, odd_rows, seed):
    rng = random.Random(seed)
    rows = list(odd_rows) + [(1000 + i, words(rng, rng.randrange(1, 200)), f"s{int(30 * rng.random() ** 3)}") for i in range(300)]
    docs = clashing(make_docs(spark, rows))
    out = mixing.mix(docs)
    assert out.columns == docs.columns + ["size_", "source_size_", "target_", "taken_", "finish_"]
    size = [(s, len(WORD.findall(t or ""))) for _, t, s in rows]
    sizes = Counter()
    for s, n in size:
        sizes[s] += n
    want = brute_targets(sizes, (5, 2, 1), 1.5 * sum(sizes.values()))
    got = out.groupBy("source").agg(F.max("target_").alias("t"), F.sum("taken_").alias("n"), F.max("source_size_").alias("all"),
                                    F.max(F.col("taken_") - 2 * F.col("size_")).alias("over")).collect()
    assert len(got) == len(sizes)
    for r in got:
        assert r["t"] == pytest.approx(want[r["source"]]) and r["n"] == math.floor(r["t"]) and r["all"] == sizes[r["source"]] and r["over"] <= 0
    finish = [r["finish_"] for r in out.select("finish_").collect()]
    there = [f for f in finish if f is not None]
    assert there == sorted(there) and finish[len(there):] == [None] * (len(finish) - len(there))


def test_mix_against_sql_and_again(spark, odd):
    pick = ["doc_id", "size", "source_size", "target", "taken", "finish"]
    got = rows_of(mixing.mix(odd).select(*pick))
    assert got == run_sql(mixing.MIX_SQL, documents=odd) == rows_of(mixing.mix(odd.repartition(7)).select(*pick))


def test_mix_empty(empty, spark):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(make_docs(spark, [(1, None, "a"), (2, "", None)])).where("taken = 0 and finish is null").count() == 2


# ---- quality
def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op5_quality_classifier(spark, sf).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.98
    good = [r for r in held if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) / len(good) > 0.99
    assert docs.count() > len(got)


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(quality.classify(docs, labels)) == rows_of(quality.classify(docs, turned))


def test_quality_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(clashing(odd), labels)
    assert got.count() == len(odd_rows) and got.where("score between 0 and 1 and predicted in (0, 1)").count() == len(odd_rows)
    assert quality.classify(empty, labels).count() == 0
    none = labels.limit(0)
    assert {r["score"] for r in quality.classify(odd, none).collect()} == {0.5}
    odd_labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, odd_labels).count() == len(odd_rows)


# ---- secrets
def test_secret_candidates(spark, odd, odd_rows):
    rows = odd_rows + [(300, "x " + "A" * 20 + "\n" + "b" * 15 + " " + "c" * 16 + "é/" + "d" * 17, "a"), (301, "q" * 40, "a"), (301, "q" * 40, "a")]
    got = sorted((r["doc_id"], r["begin"], r["end"], r["candidate"], r["before"], r["after"])
                 for r in secrets.candidates(clashing(make_docs(spark, rows))).collect())
    want = sorted({(d, m.start(), m.end(), m.group(), t[max(p, m.start() - 40):m.start()], None)
                   for d, t, _ in rows if t for p, m in zip([0, *(x.end() for x in re.finditer(r"[A-Za-z0-9+/_-]{16,}", t))], re.finditer(r"[A-Za-z0-9+/_-]{16,}", t))})
    assert [g[:5] for g in got] == [w[:5] for w in want]


def test_secret_scan(spark):
    rng = random.Random(1)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, want = [], set()
    for i in range(400):
        body = words(rng, 30)
        kind = i % 4
        secret = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), hexa(40), hexa(18), None][kind]
        middle = [f" {secret} ", f' token = "{secret}" ', f" password={secret} ",
                  rng.choice([" 4539148803436467 ", " thtionthereingtionthe ", " jane.thereingtion@mail-thereingtions.example.com ", f" http://a.b/{'thering/' * 4} "])][kind]
        rows.append((i, body + middle + words(rng, 30), "a"))
        if secret:
            want.add((i, (body + middle).index(secret)))
    got = {(r["doc_id"], r["begin"]) for r in secrets.scan(make_docs(spark, rows)).collect()}
    assert got == want


def test_secret_scan_of_odd_rows(odd, empty):
    assert secrets.scan(clashing(odd)).count() == 0
    assert secrets.scan(empty).count() == 0


# ---- fingerprints
def shingles(text, k=5):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_fingerprints(spark, odd_rows):
    import hashlib
    rng = random.Random(9)
    rows = list(odd_rows)
    for i in range(40):
        w = words(rng, rng.choice([3, 6, 20, 300]), 5000).split()
        rows += [(500 + 2 * i, " ".join(w), "a"), (501 + 2 * i, " ".join(w[:len(w) * 3 // 4] + ["x"]), "a")]
    got = minhash.edited(clashing(make_docs(spark, rows))).collect()
    assert len(got) == len(rows)
    text = {}
    for d, t, _ in rows:
        text.setdefault(d, set()).add(t or "")
    order = sorted((d for d in text if d is not None), reverse=True) + [None]
    prints, errors = {}, []
    for r in got:
        after = text[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        sure = len(after) == 1 and len(text[r["doc_id"]]) == 1
        if not sure:
            continue
        t, nxt = next(iter(text[r["doc_id"]])), next(iter(after))
        m = len(t) // 3
        edited = t[:len(t) - m] + nxt[:m]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        for other, near in ((edited, r["near_edited"]), (nxt, r["near_next"])):
            a, b = shingles(t), shingles(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
            assert 0 <= near <= 1
    assert len(errors) > 150 and max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.02


def test_fingerprints_of_few_rows(spark, empty):
    assert minhash.edited(empty).count() == 0
    r = minhash.edited(make_docs(spark, [(1, "a b c d e f", "s")])).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 11


# ---- pipeline
def test_pipeline_stages(spark, odd, empty, tmp_path):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline
    sf = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in (clashing(sf.unionByName(odd)), empty):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if i < 4:
                assert out.columns == docs.columns, name
                path = f"{tmp_path}/{docs.count()}-{i}"
                out.write.parquet(path)
                docs = spark.read.parquet(path)
            else:
                assert out.columns[:len(docs.columns)] == docs.columns and out.where(F.col(out.columns[-2]) <= 0).count() == 0


def test_pipeline_run(spark):
    import corpus_pipeline
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.run(spark, SF)
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 < len(ids) == len(set(ids)) < docs.count()
    hit = {r["doc_id"] for r in queries.op3_benchmark_decontamination(spark, SF).collect()}
    assert not hit & set(ids)
    found = queries.pii.scan(kept.select("doc_id", "text"))
    assert found.where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert kept.join(labels, "doc_id").where("quality = 1").count() > 0
