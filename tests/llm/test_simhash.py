"""SimHash near-duplicates against brute force."""

import random

import xxhash

from ebbflow.llm import graph, simhash

from .conftest import clashing, make_docs, words


def brute_fingerprint(text, k):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ")
         .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    grams = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(fps, bits):
    """fps: list of (id, fp); component id by union over all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints(odd, odd_rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % (1 << 64)) for r in simhash.fingerprints(odd, 3).collect())
    assert got == sorted((d is None, d or 0, brute_fingerprint(t, 3)) for d, t, _ in odd_rows)


def test_whole_query_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = words(rng, 150).split()
        for c in range(8):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
            rows.append((g * 10 + c, " ".join(w), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, rows[0][1], "s"), (902, rows[0][1], "s")]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(clashing(make_docs(spark, rows))).collect()}
    fps = [(d, brute_fingerprint(t, 3)) for d, t, _ in rows]
    want = {(d, f"{fp:016x}", c) for (d, fp), c in zip(fps, brute_components(fps, 2))}
    assert got == want


def test_links_of_full_and_sparse_keys(spark):
    """Random families of close fingerprints, with keys over and under the dense limit."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(120):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for bits in (0, 1, 2):
        for dense in (4, 10_000):
            links = simhash.near_links(df, bits, 5, dense).collect()
            for a, b in ((r["a"], r["b"]) for r in links):
                assert bin((a ^ b) % (1 << 64)).count("1") <= bits
            roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
            want = brute_components([(simhash._signed(x), x) for x in fps], bits)
            assert [roots.get(simhash._signed(x), simhash._signed(x)) for x in fps] == want


def test_full_keys_stay_linear(spark):
    """One key with many fingerprints: rows per fingerprint are bounded."""
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    links = simhash.near_links(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long"), 2, 5, 64).count()
    assert links < 80 * len(fps)


def test_keep_one(spark, odd, odd_rows):
    kept = simhash.keep_one(clashing(odd))
    assert kept.columns == clashing(odd).columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").select("doc_id").collect())
    fps = [(d, brute_fingerprint(t, 3)) for d, t, _ in odd_rows]
    comps = brute_components(fps, 2)
    assert ids == sorted({d for (d, _), c in zip(fps, comps) if d is not None and d == c})


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(100)] + [(None, 5), (7, None)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    root = {x: x for e in real for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in real:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == root
