"""Model selection: exact-AUC evaluator, grid search, candidates and boosting rounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial, reduce
from hashlib import blake2b
from itertools import product

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Binarizer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.models import boosting
from clickloom.models.frame import cached, click_probability, side_by_side
from clickloom.models.trees import Boost
from clickloom.operators import metrics
from clickloom.operators.split import add_fold, sample
from clickloom.session import materialize


class ExactAuc(Evaluator):
    """Tie-aware AUC over every row, without binning."""

    def _evaluate(self, dataset: DataFrame) -> float:
        score = click_probability() if "probability" in dataset.columns else F.col("prediction")
        value = metrics.scalar(metrics.roc_auc(dataset.withColumn("_score", score), "_score", "label"))
        return 0.5 if value is None else float(value)

    def isLargerBetter(self) -> bool:
        return True


def grid_search(
    train: DataFrame, estimator: Estimator, grid: list[dict], folds: int = 3, parallelism: int = 2
) -> CrossValidatorModel:
    """Every setting of ``grid`` on hash folds, judged by exact AUC."""
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=ExactAuc(),
        numFolds=folds, foldCol="fold", parallelism=parallelism,
    )
    with cached(add_fold(train, folds)) as rows:
        return search.fit(rows)


def grid_report(model: CrossValidatorModel) -> list[tuple[str, float, float]]:
    """``(setting, mean, deviation)`` per grid point, best first."""
    rows = []
    for setting, mean, std in zip(model.getEstimatorParamMaps(), model.avgMetrics, model.stdMetrics):
        named = ", ".join(f"{p.name}={v}" for p, v in sorted(setting.items(), key=lambda kv: kv[0].name))
        rows.append((named, float(mean), float(std)))
    return sorted(rows, key=lambda r: -r[1])


def bernoulli_pipeline() -> Pipeline:
    """Features above 0 count as present, then Spark's Bernoulli naive Bayes."""
    binary = Binarizer(threshold=0.0, inputCol="features", outputCol="binary")
    return Pipeline(stages=[binary, NaiveBayes(modelType="bernoulli", featuresCol="binary", smoothing=1.0)])


def candidates(boost: Boost = Boost(rounds=5)) -> dict[str, Estimator]:
    """The fixed list of pipelines a model search tries."""
    return {
        "bernoulli_nb": bernoulli_pipeline(),
        "logistic": LogisticRegression(maxIter=20),
        "boosted": boost.classifier(),
    }


def rank_candidates(train: DataFrame, valid: DataFrame, models: dict[str, Estimator]) -> list[tuple[str, float]]:
    """Validation AUC of each candidate, best first."""
    evaluator = ExactAuc()
    with cached(train) as rows:
        scores = [(name, evaluator.evaluate(e.fit(rows).transform(valid))) for name, e in models.items()]
    return sorted(scores, key=lambda s: -s[1])


def space(seed: int | str = 2017, n: int | None = None) -> dict[str, Estimator]:
    """The whole grid of pipelines in the order of a hash of their settings, or the first ``n`` of them."""
    every: dict[str, Estimator] = {"bernoulli": bernoulli_pipeline()}
    for reg, elastic in product([0.0, 1e-3, 1e-2, 1e-1], [0.0, 0.5, 1.0]):
        every[f"logistic reg={reg} l1={elastic}"] = LogisticRegression(maxIter=20, regParam=reg, elasticNetParam=elastic)
    for depth, rounds, step in product([2, 4, 6], [5, 10, 20], [0.1, 0.3]):
        every[f"boosted depth={depth} rounds={rounds} step={step}"] = Boost(rounds, depth, step).classifier()
    for trees, depth in product([10, 30, 100], [3, 6]):
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=1)
        every[f"forest trees={trees} depth={depth}"] = forest
    order = sorted(every, key=lambda name: blake2b(f"{seed}:{name}".encode()).digest())
    return {name: every[name] for name in order[:n]}


@dataclass(frozen=True)
class Halving:
    """``log``: (rung, model, rows, auc) of every fit; the winner is fitted on all rows."""

    winner: str
    model: Model
    log: list[tuple[int, str, int, float]]

    @property
    def rows_fitted(self) -> int:
        """Rows of all fits; a candidate is fitted once on the same rows."""
        return sum(rows for _, rows in {(name, rows) for _, name, rows, _ in self.log})


def _tried(models: dict[str, Estimator], rows: DataFrame, valid: DataFrame, name: str) -> tuple[str, Model, float]:
    model = models[name].fit(rows)
    return name, model, ExactAuc().evaluate(model.transform(valid))


def halving(
    train: DataFrame, valid: DataFrame, models: dict[str, Estimator], keep: int = 3, seed: int | str = "rung", samples: bool = True
) -> Halving:
    """All candidates on a small sample, the best ``1 / keep`` of them on ``keep`` times as many rows, and so on to all rows.

    Samples are nested and depend on row keys alone, so the winner does too. Ties go to the first name. Without ``samples`` every
    rung has all rows: each candidate is fitted on them once, and no sample decides what is left.
    """
    log, left, model = [], sorted(models), None
    tried: dict[str, tuple[str, Model, float]] = {}
    rungs = 1
    while keep**rungs < len(left):
        rungs += 1
    # Both tables are kept once for all fits.
    with cached(train) as rows, cached(valid) as judged:
        for rung in range(rungs + 1):
            share = float(keep) ** (rung - rungs)
            part = sample(rows, share, seed=seed) if samples and rung < rungs else rows
            scored = []
            if samples or not tried:
                with cached(part) as held:
                    n = held.count()
                    fits = side_by_side(train.sparkSession, partial(_tried, models, held, judged), left)
                    tried = {fit[0]: fit for fit in fits}
            for name, fitted, auc in map(tried.get, left):
                log.append((rung, name, n, auc))
                scored.append((-auc, name, fitted))
            scored.sort(key=lambda s: s[:2])
            left = [name for _, name, _ in scored[: max(1, len(scored) // keep)]]
            model = scored[0][2]
    return Halving(left[0], model, log)


def kfold_auc(train: DataFrame, build: Callable[[], Estimator], folds: int = 5) -> DataFrame:
    """AUC on each hash fold of a model fitted on the others, ``(fold, auc)``."""
    with cached(add_fold(train, folds)) as rows:

        def held_scores(k: int) -> DataFrame:
            held = build().fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k))
            score = click_probability() if "probability" in held.columns else F.col("prediction")
            return held.select("fold", "label", score.alias("score"))

        scored = reduce(DataFrame.unionByName, side_by_side(train.sparkSession, held_scores, range(folds), folds))
        return materialize(metrics.roc_auc(scored, "score", "label", ("fold",)), "folds")


def cv_rounds(train: DataFrame, settings: boosting.Boosting, folds: int = 3) -> DataFrame:
    """Mean and deviation of the validation AUC after each round, over hash folds.

    The folds advance together; patience counts the rounds since the best mean, and none is fitted past it.
    """
    patience = settings.patience or settings.rounds
    # The runs log every round and leave stopping to the mean.
    alone = replace(settings, patience=settings.rounds)
    rows = materialize(add_fold(train, folds), "folds")
    held = [rows.where(F.col("fold") == k) for k in range(folds)]
    runs = [boosting.Session(rows.where(F.col("fold") != k), held[k], alone) for k in range(folds)]
    done, best = 0, 0
    while done < settings.rounds and done < best + patience:
        length = min(settings.chunk, best + patience - done, settings.rounds - done)
        logs = [dict(r.go_on(length).log) for r in runs]
        done += length
        means = [sum(log[i] for log in logs) / folds for i in range(done)]
        best = means.index(max(means)) + 1
    table = [(i, log[i]) for log in logs for i in range(done)] if done else []
    log = train.sparkSession.createDataFrame(table, "iter int, AUC double")
    return log.groupBy("iter").agg(F.avg("AUC").alias("AUC"), F.stddev_pop("AUC").alias("std"), F.count("*").alias("folds"))
