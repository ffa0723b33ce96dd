"""Whole runs from train and test CSV to a submission folder.

Each run returns a ``Run`` with the folder written, whose name carries the validation
score, and the metrics measured on the way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.models import boosting, frame, network, random_trees, search, stacking, trees
from clickloom.models.online import FtrlModel, hashed_slots
from clickloom.operators import encode, ensemble, factorise, ftrl, logs, metrics, naive_bayes, prep, split
from clickloom.session import materialize
from clickloom.sources import readers, schema, writers


@dataclass(frozen=True)
class Inputs:
    """Where a run reads and writes, and how it prepares its rows."""

    train: str
    test: str
    out: str
    n_counts: int = 6
    sample: float = 1.0
    valid: float = 0.1
    scaled: bool = False
    unique_key: bool = False
    save: str | None = None
    fill: dict[str, float | str] = field(default_factory=lambda: prep.FILL_NONE)


@dataclass(frozen=True)
class Run:
    path: str
    metrics: dict[str, float]


@dataclass(frozen=True)
class Prepared:
    fit: DataFrame
    valid: DataFrame
    test: DataFrame
    features: list[str]


def prepare(spark: SparkSession, inputs: Inputs) -> Prepared:
    """Read, derive features, sample the train rows and split off validation rows."""
    imps = readers.read_train_test(spark, inputs.train, inputs.test)
    table = materialize(frame.model_frame(imps, inputs.n_counts, inputs.fill, unique_key=inputs.unique_key), "features", ("split",))
    features = prep.feature_columns(table)
    train = table.where("split = 'train'")
    if inputs.sample < 1.0:
        train = split.sample(train, inputs.sample)
    test = table.where("split = 'test'")
    if inputs.scaled:
        scaler = encode.fit_scaler(train, features)
        train, test = encode.scale(train, scaler), encode.scale(test, scaler)
    labelled = frame.assemble(train, features).withColumn("label", F.col("click").cast("double"))
    fit, valid = split.train_valid_split(labelled, inputs.valid)
    return Prepared(fit, valid, frame.assemble(test, features), features)


def _auc(scored: DataFrame, score: str = "click_score") -> float | None:
    return metrics.scalar(metrics.roc_auc(scored, score, "label"))


def _submit(scored: DataFrame, score: str, inputs: Inputs, run: str, auc: float | None) -> str:
    path = writers.scored_path(inputs.out, run, "auc", auc if auc is not None else float("nan"))
    # A run repeated with the same score replaces its file.
    return writers.write_csv(writers.submission_frame(scored, score), path, mode="overwrite")


def _save(model: MLWritable, inputs: Inputs, name: str) -> None:
    """Write the fitted model below ``inputs.save``, if that is given, in place of an earlier one of the name."""
    if inputs.save is not None:
        model.write().overwrite().save(f"{inputs.save}/{name}")


def _finish(name: str, inputs: Inputs, data: Prepared, score: Callable[[DataFrame], DataFrame]) -> Run:
    """Measure ``click_score`` on the validation rows, then write it for the test rows."""
    auc = _auc(score(data.valid))
    return Run(_submit(score(data.test), "click_score", inputs, name, auc), {"auc": auc})


def boosted(spark: SparkSession, inputs: Inputs, boost: trees.Boost = trees.Boost()) -> Run:
    """Bagged boosted trees on the count features."""
    data = prepare(spark, inputs)
    model = trees.fit_classifier(data.fit, boost)
    _save(model, inputs, "boosted")
    return _finish("boosted", inputs, data, lambda df: model.transform(df).withColumn("click_score", frame.click_probability()))


def boosted_early_stop(
    spark: SparkSession, inputs: Inputs, settings: boosting.Boosting = boosting.Boosting(patience=20)
) -> tuple[Run, DataFrame]:
    """Boosted trees stopped on the validation AUC, with all reports and the split counts."""
    data = prepare(spark, inputs)
    model = boosting.fit(data.fit, settings, data.valid)
    _save(boosting.BoostedStage(model), inputs, "early-stop")

    def score(df: DataFrame) -> DataFrame:
        return boosting.score(model, df, "click_score")

    valid = materialize(score(data.valid).select("label", "click_score"), "valid")
    at_half = metrics.threshold_metrics(valid, "click_score", "label").first()
    measured = {
        "auc": _auc(valid),
        "ap": metrics.scalar(metrics.average_precision(valid, "click_score", "label")),
        "precision": at_half["precision"],
        "recall": at_half["recall"],
        "rounds": model.best_rounds,
    }
    path = _submit(score(data.test), "click_score", inputs, "early-stop", measured["auc"])
    return Run(path, measured), spark.createDataFrame(model.splits(data.features), "feature string, splits long, gain double")


def categorical(
    spark: SparkSession, inputs: Inputs, boost: trees.Boost = trees.Boost(), categories: tuple[str, ...] = schema.CATEGORIES
) -> Run:
    """Boosted trees on the codes and the click rates of the named categories and their pairs, cut at the best validation round."""
    data = prepare(spark, inputs)
    parts = [data.valid.drop("features"), data.test.drop("features")]
    fit, parts, features = trees.with_category_rates(data.fit.drop("features"), parts, categories, data.features)
    fit, valid, test = (frame.assemble(part, features) for part in (fit, *parts))
    model = trees.fit_classifier(fit, boost)
    rounds = logs.best_iteration(trees.iteration_log(model, valid, "valid")).first()["best_iter"] + 1
    return _finish(
        "categorical", inputs, Prepared(fit, valid, test, features),
        lambda df: trees.with_staged_probability(model, df, rounds, "click_score"),
    )


def estimator_run(spark: SparkSession, inputs: Inputs, name: str, build: Callable[[int], Estimator]) -> Run:
    """Any estimator over ``features``/``label``: perceptron, factorisation machine, naive Bayes."""
    data = prepare(spark, inputs)
    with frame.cached(data.fit) as rows:
        model = build(len(data.features)).fit(rows)
    _save(model, inputs, name)

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        value = frame.click_probability() if "probability" in out.columns else F.col("prediction")
        return out.withColumn("click_score", value)

    return _finish(name, inputs, data, score)


def perceptron(spark: SparkSession, inputs: Inputs, epochs: int = 50, **settings) -> Run:
    """ReLU layers with dropout, stopped on held rows; ``settings`` replace those of the network."""
    return estimator_run(spark, inputs, "perceptron", lambda width: network.deep(width, epochs, **settings))


def perceptron_folds(spark: SparkSession, inputs: Inputs, folds: int = 5, epochs: int = 50, **settings) -> Run:
    """Perceptron judged by its mean AUC over folds, then fitted on all train rows."""
    data = prepare(spark, inputs)
    train = data.fit.unionByName(data.valid)
    width = len(data.features)
    aucs = search.kfold_auc(train, lambda: network.deep(width, epochs, **settings), folds)
    summary = metrics.fold_summary(aucs, "auc").first()
    model = network.deep(width, epochs, **settings).fit(train)
    _save(model, inputs, "perceptron-folds")
    scored = model.transform(data.test).withColumn("click_score", frame.click_probability())
    path = _submit(scored, "click_score", inputs, "perceptron-folds", summary["mean_auc"])
    return Run(path, {"auc": summary["mean_auc"], "std_auc": summary["std_auc"]})


def tuned(
    spark: SparkSession, inputs: Inputs, boost: trees.Boost, depths: list[int], steps: list[float], folds: int = 5
) -> Run:
    """Boosted trees with the depth and step a grid search over folds likes best."""
    data = prepare(spark, inputs)
    estimator = boost.classifier()
    grid = ParamGridBuilder().addGrid(estimator.maxDepth, depths).addGrid(estimator.stepSize, steps).build()
    found = search.grid_search(data.fit, estimator, grid, folds)
    best = search.grid_report(found)[0]
    run = _finish(
        "tuned", inputs, data, lambda df: found.bestModel.transform(df).withColumn("click_score", frame.click_probability())
    )
    return Run(run.path, {**run.metrics, "cv_auc": best[1], "cv_std": best[2]})


def factorisation_machine(
    spark: SparkSession, inputs: Inputs, m: factorise.Machine = factorise.Machine(rule="adam", rate=0.05), epochs: int = 5,
    batches: int = 2, size: int = 1 << 20,
) -> Run:
    """A machine on hashed categories and time parts, the epoch with the best validation loss kept."""
    imps = prep.prepare(readers.read_train_test(spark, inputs.train, inputs.test), inputs.fill)
    rows = factorise.slots(imps, [*schema.CATEGORIES, "tweekday", "thour"], size)
    rows = materialize(rows.select("ID", "split", F.col("click").cast("double").alias("y"), "x"), "slots", ("split",))
    train = rows.where("split = 'train'")
    if inputs.sample < 1.0:
        train = split.sample(train, inputs.sample)
    fit, valid = split.train_valid_split(train, inputs.valid)
    model = factorise.fit(fit, m, epochs, batches, valid)
    if inputs.save is not None:
        writers.write_weights(model.weights.select("idx", "w", "v"), f"{inputs.save}/fm")
    judged = factorise.score(valid, model.weights, m).join(valid.select("ID", F.col("y").alias("label")), "ID")
    auc = _auc(judged, "click")
    test = factorise.score(rows.where("split = 'test'"), model.weights, m)
    best = model.log[model.best_epoch] if model.log else (0, None, None)
    return Run(_submit(test, "click", inputs, "fm", auc), {"auc": auc, "loss": best[1], "held_loss": best[2]})


def best_candidate(spark: SparkSession, inputs: Inputs, candidates: int = 12) -> Run:
    """The best of a generated space of pipelines, found by halving on growing samples."""
    data = prepare(spark, inputs)
    found = search.halving(data.fit, data.valid, search.space(n=candidates))
    _save(found.model, inputs, "best")
    name = found.winner.replace(" ", "-").replace("=", "")
    return _finish(
        name, inputs, data, lambda df: found.model.transform(df).withColumn("click_score", frame.click_probability())
    )


def bayes(spark: SparkSession, inputs: Inputs) -> Run:
    """Bernoulli naive Bayes in closed form; writes hard classes."""
    data = prepare(spark, inputs)
    model = naive_bayes.fit_bernoulli_nb(data.fit, data.features)
    return _finish(
        "bayes", inputs, data, lambda df: model.transform(df).withColumn("click_score", F.col("prediction").cast("double"))
    )


def _stack_levels(forest: int, extra: int) -> tuple[list[Estimator], Estimator]:
    lasso = LinearRegression(elasticNetParam=1.0, regParam=1e-3)
    return [trees.random_forest(forest), random_trees.RandomTrees(random_trees.Random(extra))], lasso


def blended(
    spark: SparkSession,
    inputs: Inputs,
    boost: trees.Boost = trees.Boost(),
    forest: int = 250,
    extra: int = 100,
    folds: int = 3,
) -> dict[str, Run]:
    """Stacked and boosted models and their weighted blend; writes all three."""
    data = prepare(spark, inputs)
    levels, last = _stack_levels(forest, extra)
    _, (valid_s, test_s) = stacking.fit_stack(data.fit, [data.valid, data.test], levels, last, folds)
    model = trees.fit_classifier(data.fit, boost)
    valid_b, test_b = (
        model.transform(df).select("ID", frame.click_probability().alias("click")) for df in (data.valid, data.test)
    )
    labels = data.valid.select("ID", "label")
    valid = {"stacked": valid_s.select("ID", F.col("prediction").alias("click")), "boosted": valid_b}
    test = {"stacked": test_s.select("ID", F.col("prediction").alias("click")), "boosted": test_b}
    weights = {"stacked": ensemble.STACK_WEIGHT, "boosted": ensemble.BOOST_WEIGHT}
    runs = {}
    for scores in (valid, test):
        written = {m: materialize(df, m) for m, df in scores.items()}
        scores.update(written)
        scores["blend"] = ensemble.blend([(scores[m], w) for m, w in weights.items()])
    for name in ("stacked", "boosted", "blend"):
        auc = _auc(valid[name].join(labels, "ID"), "click")
        runs[name] = Run(_submit(test[name], "click", inputs, name, auc), {"auc": auc})
    return runs


def merged(spark: SparkSession, stacked_path: str, boosted_path: str, out: str, weights: tuple[float, float]) -> str:
    """Blend two prediction files by ID; a weight of 0 passes the other file through."""
    parts = zip((readers.read_predictions(spark, p) for p in (stacked_path, boosted_path)), weights)
    return writers.write_csv(ensemble.blend(list(parts)), out)


def online(
    spark: SparkSession,
    inputs: Inputs,
    columns: list[str],
    p: ftrl.Ftrl = ftrl.Ftrl(),
    epochs: int = 5,
    batches: int | None = None,
    interactions: bool = False,
    holdout_every: int | None = None,
    holdout_after: str | None = None,
) -> Run:
    """FTRL on hashed columns. The metrics are the AUC on the train rows, as labelled, and
    the losses of the last epoch; held-out rows are measured but not learnt.
    """
    barred = {"ID", "click"} & set(columns)
    if barred:
        raise ValueError(f"{sorted(barred)} must not be hashed as features")
    imps = prep.prepare(readers.read_train_test(spark, inputs.train, inputs.test), inputs.fill)
    imps = prep.cast_categorical(imps, ["siteid"])
    hashed = hashed_slots(imps, columns, p.size, interactions)
    y = F.col("click").cast("double").alias("y")
    train = hashed.where("split = 'train'").select("ID", "datetime", y, "x")
    if holdout_every or holdout_after:
        train = prep.mark_holdout(train, ["datetime", "ID"], holdout_every, holdout_after)
    model = ftrl.fit(train, p, epochs, batches)
    _save(FtrlModel(model.best_state, columns, p, "ID", interactions), inputs, "ftrl")
    seen = ftrl.score(train.select("ID", "y", "x"), model.best_state, p).withColumn("label", F.col("y"))
    auc = _auc(seen, "p")
    test = ftrl.score(hashed.where("split = 'test'").select("ID", "x"), model.best_state, p)
    last = [r for r in model.log if r["epoch"] == epochs - 1]
    measured = {"train_auc": auc, "loss": _mean(last, "loss", "rows"), "held_loss": _mean(last, "held_loss", "held_rows")}
    return Run(_submit(test, "p", inputs, "ftrl", auc), {k: v for k, v in measured.items() if v is not None})


def _mean(log: list[dict[str, float]], total: str, rows: str) -> float | None:
    n = sum(r[rows] for r in log)
    return sum(r[total] for r in log) / n if n else None
