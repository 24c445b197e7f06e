"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenation by column name; columns missing on a side are null."""
    return a.unionByName(b, allowMissingColumns=True)


def intersect_keys(a: DataFrame, b: DataFrame, k: Sequence[str]) -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(*k).intersect(b.select(*k))


def except_keys(expected: DataFrame, present: DataFrame, k: Sequence[str], keep_dups: bool = False) -> DataFrame:
    """Expected keys that are not present (``exceptAll`` keeps multiplicity)."""
    e, p = expected.select(*k), present.select(*k)
    return e.exceptAll(p) if keep_dups else e.subtract(p)
