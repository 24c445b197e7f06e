"""Connected components of an undirected graph, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def _least_neighbour(both: DataFrame) -> DataFrame:
    """Node and the least of itself and its neighbours (partial aggregation
    absorbs nodes with many neighbours)."""
    return both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("n"), F.least("u", "m").alias("m"))


def _mark(e: DataFrame):
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (columns ``a``, ``b`` of
    type long): root is the least node that can be reached.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to its least neighbour; then every node links its smaller
    neighbours to the least of them.  Each step keeps the components and never
    has more edges than before, so a component of any size becomes a star
    around its least node after a logarithmic number of rounds.  Only two
    numbers a round come to the driver (edge count and checksum).  Null ends
    and loops are ignored; an empty input gives an empty result."""
    e = settled(edges.where("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(e)
    for _ in range(max_rounds if mark["n"] else 0):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both)
        large = (both.join(least, F.col("u") == F.col("n")).where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = (large.join(least, F.col("u") == F.col("n"))
                 .select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        e = settled(small)
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        if mark["n"]:
            raise RuntimeError("components: the number of rounds was exceeded")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
