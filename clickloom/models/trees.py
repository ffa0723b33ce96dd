"""Boosted trees, forests and single trees on Spark ML.

Substitutes, not equals: Spark has no leaf-count limit, base score, Huber split loss or
random split thresholds, and its feature sampling is per node.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import scalar as fn
from clickloom.models.frame import cached, click_probability, side_by_side
from clickloom.operators import logs, metrics, target
from clickloom.session import materialize, new_path

SEED = 2017


@dataclass(frozen=True)
class Boost:
    """Boosting settings; depths up to 30 are possible. The defaults are small: runs name their own."""

    rounds: int = 20
    depth: int = 5
    step: float = 0.1
    row_share: float = 1.0
    feature_share: str = "all"
    bins: int = 32
    seed: int = SEED

    def classifier(self, **extra: object) -> GBTClassifier:
        return GBTClassifier(**self._params(), **extra)

    def regressor(self, **extra: object) -> GBTRegressor:
        return GBTRegressor(**self._params(), **extra)

    def _params(self) -> dict[str, object]:
        return {
            "maxIter": self.rounds,
            "maxDepth": self.depth,
            "stepSize": self.step,
            "subsamplingRate": self.row_share,
            "featureSubsetStrategy": self.feature_share,
            "maxBins": self.bins,
            "seed": self.seed,
        }


# Row and feature bagging of the two boosted variants.
BAGGED = {"row_share": 0.95, "feature_share": "0.4"}
LIGHT_BAGGED = {"row_share": 0.5, "feature_share": "0.6"}


def _tree_outputs(model: GBTClassificationModel, df: DataFrame, rounds: int) -> DataFrame:
    """Add ``_outputs``: the weighted output of each of the first ``rounds`` trees."""
    out, outputs = df, []
    for i, (tree, weight) in enumerate(zip(model.trees[:rounds], model.treeWeights)):
        staged = tree.copy().setFeaturesCol(model.getFeaturesCol()).setPredictionCol(f"_t{i}")
        out = staged.transform(out)
        outputs.append(F.col(f"_t{i}") * float(weight))
    return out.select(*df.columns, F.array(*outputs).alias("_outputs"))


def tree_margins(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    """Add ``margins``: the boosted margin after each tree, first to last."""
    staged = _tree_outputs(model, df, len(model.trees))
    return staged.select(*df.columns, fn.running_sum(F.col("_outputs")).alias("margins"))


def with_staged_probability(model: GBTClassificationModel, df: DataFrame, rounds: int, name: str) -> DataFrame:
    """Add the click probability after the first ``rounds`` trees."""
    staged = _tree_outputs(model, df, rounds)
    return staged.withColumn(name, fn.sigmoid(2.0 * fn.array_sum(F.col("_outputs")))).drop("_outputs")


def iteration_log(model: GBTClassificationModel, df: DataFrame, run: str, label: str = "label") -> DataFrame:
    """AUC after every iteration as ``(run, iter, AUC)``; all iterations in one aggregation."""
    staged = tree_margins(model, df).select(label, F.posexplode_outer("margins").alias("iter", "score"))
    by_iter = metrics.roc_auc(staged, "score", label, ("iter",))
    return by_iter.select(F.lit(run).alias("run"), "iter", F.col("auc").alias("AUC"))


def fit_with_patience(
    train: DataFrame, valid: DataFrame, boost: Boost, patience: int = 20
) -> tuple[GBTClassificationModel, int, DataFrame]:
    """Fit all rounds, then cut back to where a watcher of the validation AUC would have stopped.

    Spark ML cannot go on from a fitted model, so the rounds after the stop are fitted and left out; ``fit_builtin_stop``
    stops for good, on the validation loss. Returns the model, its best number of rounds and the validation log.
    """
    with cached(train) as rows:
        model = boost.classifier().fit(rows)
    log = materialize(iteration_log(model, valid, "valid"), "log")
    best = logs.early_stop(log, patience).first()["best_iter"] + 1
    return model, best, log


def score_rounds(model: GBTClassificationModel, df: DataFrame, rounds: int) -> DataFrame:
    """``(ID, click)`` from the first ``rounds`` trees."""
    return with_staged_probability(model, df.select("ID", model.getFeaturesCol()), rounds, "click").select("ID", "click")


def fit_classifier(train: DataFrame, boost: Boost) -> GBTClassificationModel:
    with cached(train) as rows:
        return boost.classifier().fit(rows)


def score_classifier(model: GBTClassificationModel | PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).select("ID", click_probability().alias("click"))


def fit_builtin_stop(train: DataFrame, boost: Boost, valid_column: str = "is_valid") -> GBTClassificationModel:
    """Fit with Spark's own stop: no further round once validation loss stops improving."""
    with cached(train) as rows:
        return boost.classifier(validationIndicatorCol=valid_column, validationTol=0.0).fit(rows)


def with_category_rates(
    train: DataFrame, others: list[DataFrame], categories: Sequence[str], features: list[str], most: int = 2
) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """The tables with the ordered click rates of the named categories and of their combinations beside the codes.

    Returns them with the names of all features.
    """
    combos = target.combinations_of(categories, most)
    widened, rest = target.ordered_rates(train, others, combos)
    return materialize(widened, "rates"), rest, [*features, *map(target.rate_name, combos)]


def split_counts(
    model: GBTClassificationModel | object, spark: SparkSession, features: list[str]
) -> DataFrame:
    """How many splits use each feature, most used first, with its gain share."""
    path = new_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    used = nodes.select(F.col("nodeData.split.featureIndex").alias("idx")).where("idx >= 0")
    counted = used.groupBy("idx").agg(F.count("*").alias("splits"))
    gains = model.featureImportances
    rows = [(i, f, float(gains[i])) for i, f in enumerate(features)]
    names = spark.createDataFrame(rows, "idx int, feature string, gain double")
    # One row per feature on both sides.
    joined = F.broadcast(names).join(counted, "idx", "left").fillna(0, subset=["splits"])
    return joined.select("feature", "splits", "gain").orderBy(F.desc("splits"), "feature")


def importance_sweep(
    train: DataFrame, valid: DataFrame, features: list[str], boost: Boost
) -> list[tuple[float, int, float]]:
    """Refit on the features at least as important as each of the importances: ``(cut, n, AUC)``.

    Both tables are kept once for all fits; the fit on every feature is the first one.
    """
    with cached(train) as rows, cached(valid) as held:
        base = boost.classifier().fit(rows)
        gains = [float(base.featureImportances[i]) for i in range(len(features))]

        def refit(cut: float) -> tuple[float, int, float]:
            keep = [i for i, g in enumerate(gains) if g >= cut]
            slicer = VectorSlicer(inputCol="features", outputCol="kept", indices=keep)
            whole = len(keep) == len(features)
            model = base if whole else boost.classifier(featuresCol="kept").fit(slicer.transform(rows))
            scored = model.transform(held if whole else slicer.transform(held)).withColumn("score", F.rint(click_probability()))
            return cut, len(keep), metrics.scalar(metrics.roc_auc(scored, "score", "label"))

        return side_by_side(train.sparkSession, refit, sorted(set(gains)))


def random_forest(trees: int = 250, seed: int = SEED) -> RandomForestRegressor:
    """Shallow forest with large leaves."""
    return RandomForestRegressor(
        numTrees=trees, maxDepth=3, minInstancesPerNode=25, featureSubsetStrategy="all", seed=seed
    )


def extra_trees(trees: int = 100, seed: int = SEED) -> RandomForestRegressor:
    """Stand-in for extremely random trees: no bootstrap, few coarse split candidates."""
    return RandomForestRegressor(
        numTrees=trees, maxDepth=5, minInstancesPerNode=35, featureSubsetStrategy="all",
        bootstrap=False, subsamplingRate=0.8, maxBins=8, seed=seed,
    )


def bagged_trees(trees: int = 10, depth: int = 4, seed: int = SEED) -> RandomForestRegressor:
    """Bagging: a forest in which every tree sees every feature."""
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)


def single_tree(depth: int = 4, seed: int = SEED) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(maxDepth=depth, seed=seed)


def absolute_boost(rounds: int = 20, seed: int = SEED) -> GBTRegressor:
    """Boosting on the absolute error, the robust loss Spark offers in place of Huber's."""
    return GBTRegressor(
        maxIter=rounds, maxDepth=3, stepSize=0.1, lossType="absolute", subsamplingRate=0.7,
        minInstancesPerNode=18, featureSubsetStrategy="0.55", seed=seed,
    )
