"""Gradient-boosted counts: Poisson loss over MLlib's regression trees.

MLlib has boosted trees for squared loss only.  Counts have the log link, so a
row's margin f gives the mean mu = exp(f) and a Newton step of the Poisson loss
mu - y f is a tree fitted to (y - mu) / mu with weights mu.  Every tree is one
distributed MLlib fit over the same written matrix.  Margins are an expression
over the trees; the sum of the trees so far is written beside the rows every
few rounds, so a round never evaluates more trees than were added since.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Margins stay within these (means from about 1e-9 to 5e8).
LEAST, MOST = -20.0, 20.0
#: Trees after which the rows' sums are written again.
WRITE_EVERY = 8


def poisson_loss(label: Column, mean: Column) -> Column:
    """Mean Poisson loss, up to what depends on the label only."""
    return F.avg(mean - label * F.log(mean))


@dataclass
class CountBooster:
    """base + rate * the trees' sum = log of the mean."""

    features: list[str]
    base: float
    rate: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    #: Loss on the held-out rows after each tree that was tried.
    losses: list[float] = field(default_factory=list)

    def sums(self, df: DataFrame, name: str, carried: str | None = None, since: int = 0) -> DataFrame:
        """``df`` (with the column ``_features``) and base + rate * the trees' sum;
        ``carried`` names a column with that of the first ``since`` trees."""
        out, total = df, F.col(carried) if carried else F.lit(self.base)
        names = [f"_tree_{k}" for k in range(since, len(self.trees))]
        for tree, c in zip(self.trees[since:], names):
            out = tree.copy().setFeaturesCol("_features").setPredictionCol(c).transform(out)
            total = total + self.rate * F.col(c)
        return out.withColumn(name, total).drop(*names)

    def margins(self, df: DataFrame, name: str, carried: str | None = None, since: int = 0) -> DataFrame:
        """``df`` (with the column ``_features``) and its margin so far (see ``sums``)."""
        margin = F.least(F.greatest(F.col(name), F.lit(LEAST)), F.lit(MOST))
        return self.sums(df, name, carried, since).withColumn(name, margin)

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with the mean count; null features count as missing."""
        x = self.margins(assembler(self.features).transform(df), "_margin")
        return x.withColumn(prediction, F.exp("_margin")).drop("_margin", "_features")

    def importances(self) -> list[float]:
        """Mean importance of each feature over the trees."""
        sums = [t.featureImportances.toArray() for t in self.trees]
        return [float(sum(s[i] for s in sums) / max(1, len(sums))) for i in range(len(self.features))]

    def save(self, path: str) -> None:
        """Trees as MLlib models, the rest as one JSON row, under ``path``."""
        spark = SparkSession.getActiveSession()
        head = json.dumps({"features": self.features, "base": self.base, "rate": self.rate, "trees": len(self.trees), "losses": self.losses})
        spark.createDataFrame([(head,)], "head string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
        for k, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree-{k}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CountBooster:
        head = json.loads(spark.read.text(f"{path}/head").first()[0])
        trees = [DecisionTreeRegressionModel.load(f"{path}/tree-{k}") for k in range(head["trees"])]
        return cls(head["features"], head["base"], head["rate"], trees, head["losses"])


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")


def train_boosted_counts(train: DataFrame, features: Sequence[str], label: str = "label", rounds: int = 60, rate: float = 0.2,
                         depth: int = 5, min_rows: int = 50, subsample: float = 0.8, patience: int = 5,
                         held_percent: int = 10, seed: int = 42) -> CountBooster:
    """Boosted counts with early stopping: trees are added until the loss on
    the held-out rows (``held_percent`` of them, by a hash of their features)
    has not fallen for ``patience`` trees, at most ``rounds``; trees after the
    best one are dropped.  Every tree learns from ``subsample`` of the rows,
    chosen anew by a hash.  Without rows, or with counts that sum to 0, the
    model has no trees and says the least mean."""
    mark = F.xxhash64(*[F.col(c) for c in features], F.lit(seed))
    # every round reads the rows again: write them once
    data = cut_lineage(assembler(features).transform(train).select(
        "_features", F.greatest(F.col(label).cast("double"), F.lit(0.0)).alias("_y"), mark.alias("_mark"),
        (F.pmod(mark, F.lit(100)) < held_percent).alias("_held")))
    mean = data.where("NOT _held").agg(F.avg("_y")).first()[0]
    if not mean:
        return CountBooster(list(features), LEAST, rate)
    model = CountBooster(list(features), min(max(math.log(mean), LEAST), MOST), rate)
    best, best_at, since = None, 0, 0
    data = data.withColumn("_sum", F.lit(model.base))
    for k in range(rounds):
        if k - since >= WRITE_EVERY:
            data, since = cut_lineage(model.sums(data, "_sum", "_sum", since)), k
        learn, held = data.where("NOT _held"), data.where("_held")
        mu = F.exp("_margin")
        sample = learn.where(F.pmod(F.xxhash64("_mark", F.lit(k)), F.lit(1000)) < int(1000 * subsample))
        steps = model.margins(sample, "_margin", "_sum", since).select(
            "_features", mu.alias("_w"), F.least((F.col("_y") - mu) / mu, F.lit(1e6)).alias("_t"))
        tree = DecisionTreeRegressor(featuresCol="_features", labelCol="_t", weightCol="_w", maxDepth=depth,
                                     minInstancesPerNode=min_rows, seed=seed + k).fit(steps)
        model.trees.append(tree)
        loss = model.margins(held, "_margin", "_sum", since).agg(poisson_loss(F.col("_y"), mu)).first()[0]
        if loss is None:                                # nothing held out: all rounds
            best_at = k + 1
            continue
        model.losses.append(float(loss))
        if best is None or loss < best:
            best, best_at = loss, k + 1
        elif k + 1 - best_at >= patience:
            break
    model.trees = model.trees[:best_at]
    return model
