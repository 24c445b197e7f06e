"""Registered queries: one per operator of the inventory, each with an oracle.

A query is a callable ``(spark, sf_dir) -> DataFrame`` that reads the driver
tables (through the canonical views) and applies one operator.  Its oracle is
DuckDB SQL over the same tables, or ``None`` when the operator has no SQL
form (model fitting); those are checked in the test-suite instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def _half_even_sql(sql: str) -> str:
    """Rewrite ``round_even(x, 0)`` as an exact half-even rounding of the
    double ``x``: only a true .5 tie goes to the even neighbour (DuckDB's
    ``round_even`` also treats values just above a tie as ties, unlike
    Spark's ``bround`` and Python's ``round``)."""
    key = "round_even("
    while key in sql:
        i = sql.index(key)
        depth, j = 0, i + len(key)
        comma = None
        while True:
            ch = sql[j]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = j
            j += 1
        arg = sql[i + len(key):comma].strip()
        e = f"({arg})"
        rep = (f"(CASE WHEN {e} - floor({e}) = 0.5 THEN CASE WHEN floor({e}) % 2 = 0 THEN floor({e}) "
               f"ELSE floor({e}) + 1 END ELSE round({e}) END)")
        sql = sql[:i] + rep + sql[j + 1:]
    return sql


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with its DuckDB oracle ``sql``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, _half_even_sql(sql) if sql else sql)
        return fn
    return deco


_FITTED: dict[tuple[str, str, str], object] = {}


def fitted(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """What ``build`` gives (a written matrix, a fitted model), made once an
    application and folder: queries over one fit share it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FITTED:
        _FITTED[key] = build()
    return _FITTED[key]


def written_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series, written once for all that a model's query reads of
    them (splits, medians, features, tails): bounded by series and calendar,
    while every reading of the view joins all line items again."""
    from ..session import cut_lineage
    from ..sources import fixtures as fx
    return fitted(spark, sf_dir, "daily series", lambda: cut_lineage(fx.daily_series(spark, sf_dir)))


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    """Import every plan module so that its queries register."""
    from . import catalog  # noqa: F401
    return REGISTRY
