"""Small tables with the awkward rows that every operator must take."""

import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def make_docs(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(7)
    long_text = words(rng, 30_000)
    same = words(rng, 80)
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "one two", "b"), (6, long_text, "a"),
            (7, same, "a"), (7, same, "a"), (8, same, None), (9, same.upper(), "c"), (None, "no id here at all", "c"),
            (None, None, None), (10, words(rng, 60), "a"), (11, "é ü ñ 漢字 \U0001F600 x", "b")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make_docs(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The same rows with further columns named like results and internals."""
    from pyspark.sql import functions as F
    names = ["fingerprint", "fp", "component_id", "score", "predicted", "size", "source_size", "target", "taken", "finish",
             "spans", "hits", "k", "mark", "root", "item_id", "clean_text", "_row", "_key", "_keep", "_order", "_nth", "_text", "_bucket"]
    return df.withColumns({n: F.lit("x") for n in names})
