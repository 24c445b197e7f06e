"""Secrets of many kinds, short ones too, and look-alikes beside them."""

import random

from ebbflow.llm import secrets

from .conftest import make_docs, words

ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def test_kinds_of_secrets(spark):
    rng = random.Random(21)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    kinds = [(lambda: 'aws_secret_access_key = "', lambda: text(ALNUM + "+/", 40)), (lambda: 'token = "', lambda: text(ALNUM, 30)),
             (lambda: "use ", lambda: "AIza" + text(ALNUM, 35)), (lambda: "key is ", lambda: "sk_live_" + text(ALNUM, 24)),
             (lambda: 'password = "', lambda: f"Tr0ub4dor&{rng.randrange(10)}"), (lambda: "pwd: '", lambda: text(ALNUM, 5) + "#9x!" + text(ALNUM, 3))]
    fakes = [("commit ", "0123456789abcdef" * 2 + "01234567"), ("the ", "internal_session_manager"), ("", "/usr/local/share/documents/example"),
             ('password = "', "your_password_here"), ("password: ", "*" * 12)]
    rows, want = [], {}
    for i in range(240):
        before, secret = kinds[i % 6][0](), kinds[i % 6][1]()
        end = before[-1] if before[-1] in "\"'" else ""
        body = words(rng, 20) + " " + before
        rows.append((i, f"{body}{secret}{end} {words(rng, 20)}", "a"))
        want[i] = (len(body), len(body) + len(secret))
    for i in range(100):
        before, fake = fakes[i % 5]
        rows.append((1000 + i, f"{words(rng, 20)} {before}{fake} {words(rng, 20)}", "a"))
    got = {(r["doc_id"], r["begin"], r["end"]) for r in secrets.scan(make_docs(spark, rows)).collect()}
    found = [sum((i, *want[i]) in got for i in want if i % 6 == k) for k in range(6)]
    wrong = [sum(d == 1000 + i for d, _, _ in got for i in range(k, 100, 5)) for k in range(5)]
    assert min(found) >= 38 and max(wrong) <= 1, (found, wrong)


def test_coverage_counts_the_whole_vocabulary(spark):
    vocabulary = spark.createDataFrame([("lantern",), ("quiet",), ("tern",)], "word string")
    found = spark.createDataFrame([("quietLantern9999",), ("9f8e7d6c5b4a3f2e",)], "candidate string")
    got = {r["candidate"]: r["coverage"] for r in secrets.covered(found, vocabulary).collect()}
    assert got == {"quietLantern9999": 0.75}
