"""Exactly one row of each near-duplicate group stays, also where ids repeat."""

import random

from ebbflow.llm import simhash

from .conftest import clashing, make_docs, words


def test_one_row_of_each_group(spark):
    rng = random.Random(8)
    one, two, three = (words(rng, 120) for _ in range(3))
    near = one.upper() + " "            # the same words: the same fingerprint
    rows = [(5, one, "a"), (5, near, "b"), (5, one, "a"), (6, near, "c"),       # two near texts under the least id
            (3, two, "a"), (5, two, "b"), (None, two, "c"),                     # id 5 leads another group, not this one
            (None, three, "a"), (None, three + " ", "b")]
    kept = [(r["doc_id"], " ".join(r["text"].lower().split())) for r in simhash.keep_one(clashing(make_docs(spark, rows))).collect()]
    assert sorted(kept, key=str) == sorted([(5, one), (3, two), (None, three)], key=str)
