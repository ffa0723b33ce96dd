"""AdaBoost.R2 over regression trees: rows a tree gets wrong weigh more in the next."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.session import materialize


@dataclass(frozen=True)
class AdaBoostModel:
    trees: list[DecisionTreeRegressionModel]
    weights: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, the weighted median of the trees' outputs."""
        out = df
        for i, tree in enumerate(self.trees):
            out = tree.copy().setPredictionCol(f"_t{i}").transform(out)
        votes = [
            F.struct(F.col(f"_t{i}").alias("value"), F.lit(w).alias("weight")) for i, w in enumerate(self.weights)
        ]
        return out.select(*df.columns, weighted_median(F.array(*votes), sum(self.weights)).alias("prediction"))


def weighted_median(votes: Column, total: float) -> Column:
    """Smallest value at which the votes up to it reach half of the total weight."""
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("median"))

    def add(acc: Column, vote: Column) -> Column:
        seen = acc["seen"] + vote["weight"]
        reached = F.when(acc["median"].isNull() & (seen >= total / 2), vote["value"]).otherwise(acc["median"])
        return F.struct(seen.alias("seen"), reached.alias("median"))

    return F.aggregate(F.array_sort(votes), start, add, lambda acc: acc["median"])


def fit_adaboost(
    train: DataFrame, rounds: int = 300, depth: int = 4, rate: float = 1.0, seed: int = 2017
) -> AdaBoostModel:
    """Boost until ``rounds``, a perfect tree, or a tree no better than chance.

    The row weights are a table, written anew each round; two numbers per round reach the
    driver. Rows are weighted rather than drawn again.
    """
    tree = DecisionTreeRegressor(maxDepth=depth, weightCol="weight", predictionCol="_hat", seed=seed)
    rows = train.withColumn("weight", F.lit(1.0))
    trees: list[DecisionTreeRegressionModel] = []
    weights: list[float] = []
    for _ in range(rounds):
        model = tree.fit(rows)
        missed = materialize(
            model.transform(rows).select(*rows.columns, F.abs(F.col("label") - F.col("_hat")).alias("_miss")), "adaboost"
        )
        sums = missed.agg(
            F.max("_miss").alias("worst"),
            F.sum(F.col("weight") * F.col("_miss")).alias("missed"),
            F.sum("weight").alias("total"),
        ).first()
        if not sums["worst"]:
            return AdaBoostModel([*trees, model], [*weights, 1.0])
        loss = sums["missed"] / sums["worst"] / sums["total"]
        if loss >= 0.5:
            return AdaBoostModel(trees or [model], weights or [1.0])
        beta = loss / (1.0 - loss)
        trees.append(model)
        weights.append(rate * log(1.0 / beta))
        kept = F.pow(F.lit(beta), rate * (1.0 - F.col("_miss") / sums["worst"]))
        # Scaled to a mean weight of 1, so that many rounds cannot underflow.
        scale = sums["total"] / missed.agg(F.sum(F.col("weight") * kept).alias("s")).first()["s"]
        rows = missed.withColumn("weight", F.col("weight") * kept * scale).drop("_miss")
    return AdaBoostModel(trees, weights)
