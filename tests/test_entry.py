"""Driver contract: entry() and every registered query run on sf0.001."""

import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry_mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_mod)

NAMES = sorted(entry_mod.queries())


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "level" in df.columns


def test_oracle_keys_subset():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, name):
    df = entry_mod.queries()[name](spark, "/root/testdata/sf0.001")
    df.write.format("noop").mode("overwrite").save()
