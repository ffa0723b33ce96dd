"""Queries that fit Spark ML models and score the test impressions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import scalar as fn
from clickloom.models import adaboost, boosting, frame, network, others, random_trees, search, stacking, trees
from clickloom.models.boosting import Boosting
from clickloom.models.grow import Growth
from clickloom.operators import counts, ensemble, factorise, logs, metrics, prep, sparse, split
from clickloom.plans.registry import PREP, query, rounded
from clickloom.session import materialize, new_path
from clickloom.sources import readers, samples, schema, writers

# Settings of the runs. The early-stopped run has 100 rounds of depth 6 and patience 20; the leaf-limited one 256
# leaves, depth 10, 500 rounds of 0.03, patience 40; Huber's has trees of depth 3 with leaves of 18 rows and shares of 0.7 and 0.55.
EARLY = Boosting(rounds=100, step=0.1, base_score=0.5, patience=20, growth=Growth(depth=6))
LIGHT = Boosting(
    rounds=500, step=0.03, patience=40, bins=255,
    growth=Growth(depth=10, leaves=256, l2=0.0, min_rows=20, min_hessian=1e-3, row_share=0.5, feature_share=0.6),
)
HUBER = Boosting(
    rounds=20, step=0.1, loss="huber", growth=Growth(depth=3, l2=0.0, min_rows=18, min_hessian=0.0, row_share=0.7, feature_share=0.55)
)
# As the last level of a stack: 100 rounds of 0.001.
STACK_HUBER = replace(HUBER, rounds=100, step=0.001)
# The runs without a stop: 2,000 rounds of 0.005 at depth 30, and for the label as a number 1,300 of the library's step at depth 20.
DEEP = Boosting(rounds=2000, step=0.005, chunk=100, growth=Growth(depth=30, row_share=0.95, feature_share=0.4))
DEEP_SQUARED = replace(DEEP, rounds=1300, step=0.1, loss="squared", growth=replace(DEEP.growth, depth=20))
# Fewer and larger steps, for the run that is blended.
BAGGED = Boosting(rounds=20, step=0.1, growth=Growth(depth=6, row_share=0.95, feature_share=0.4))
STACK_FOLDS = 3

_frames: dict[tuple[str, str], DataFrame] = {}


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded features of all impressions, written once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _frames:
        _frames[key] = materialize(frame.model_frame(samples.impressions(spark, sf_dir), unique_key=True), "features", ("split",))
    return _frames[key]


def forget_features() -> None:
    """Derive the feature table anew at its next use, as after a change of the data."""
    _frames.clear()


def assembled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train rows with ``label``, test rows, and the feature names in vector order."""
    df = feature_table(spark, sf_dir)
    features = prep.feature_columns(df)
    wide = frame.assemble(df, features)
    train = frame.train_part(wide).select("ID", "label", "features")
    return train, frame.test_part(wide).select("ID", "features"), features


def regression_scores(model, test: DataFrame) -> DataFrame:
    return model.transform(test).select("ID", F.col("prediction").alias("click"))


@query("gbt_score")
def gbt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees from the base rate on, each on its own share of rows and features."""
    train, test, _ = assembled(spark, sf_dir)
    return boosting.score(boosting.fit(train, DEEP), test).select("ID", "click")


@query("gbt_light_score")
def gbt_light_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees grown best first to a number of leaves, with the stronger bagging, stopped on the validation half."""
    train, test, _ = assembled(spark, sf_dir)
    fit_rows, valid = split.train_valid_split(train, 0.5)
    return boosting.score(boosting.fit(fit_rows, LIGHT, valid), test).select("ID", "click")


@query("gbt_early_stop")
def gbt_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test scores at the round where the validation AUC was best when patience ran out; no round is fitted after that."""
    train, test, _ = assembled(spark, sf_dir)
    fit_rows, valid = split.train_valid_split(train, 0.1)
    return boosting.score(boosting.fit(fit_rows, EARLY, valid), test).select("ID", "click")


@query("gbt_builtin_stop")
def gbt_builtin_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = assembled(spark, sf_dir)
    model = trees.fit_builtin_stop(split.mark_validation(train, 0.1), trees.Boost(rounds=12))
    return trees.score_classifier(model, test)


@query("gbt_iteration_log")
def gbt_iteration_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC per iteration on the learn and test half, and their gap."""
    train, _, _ = assembled(spark, sf_dir)
    learn, test = split.train_valid_split(train, 0.5)
    model = trees.fit_classifier(learn, trees.Boost(rounds=10))
    return logs.metric_gap(trees.iteration_log(model, learn, "learn"), trees.iteration_log(model, test, "test"))


@query("gbt_categorical")
def gbt_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named categories and their pairs by click rates of earlier rows, beside their codes, stopped at the best round."""
    df = feature_table(spark, sf_dir)
    features = prep.feature_columns(df)
    fit_rows, valid = split.train_valid_split(frame.train_part(df), 0.5)
    fit_rows, (valid, test), features = trees.with_category_rates(fit_rows, [valid, frame.test_part(df)], schema.CATEGORIES, features)
    fit_rows, valid, test = (frame.assemble(part, features) for part in (fit_rows, valid, test))
    model = trees.fit_classifier(fit_rows.select("ID", "label", "features"), trees.Boost(rounds=10, depth=10))
    best = logs.best_iteration(trees.iteration_log(model, valid, "valid")).first()["best_iter"] + 1
    return trees.score_rounds(model, test, best)


@query("gbt_regress")
def gbt_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = assembled(spark, sf_dir)
    return boosting.score(boosting.fit(train, DEEP_SQUARED), test).select("ID", "click")


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and gain share of each feature in the trees of an early-stopped run."""
    train, _, features = assembled(spark, sf_dir)
    fit_rows, valid = split.train_valid_split(train, 0.1)
    used = boosting.fit(fit_rows, EARLY, valid).splits(features)
    return spark.createDataFrame(used, "feature string, splits long, gain double")


@query("select_by_importance")
def select_by_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, features = assembled(spark, sf_dir)
    fit_rows, valid = split.train_valid_split(train, 0.2)
    rows = trees.importance_sweep(fit_rows, valid, features, trees.Boost(rounds=5))
    return spark.createDataFrame(rows, "threshold double, n_features int, auc double")


@query("cv_rounds")
def cv_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean AUC of each round over the folds, as far as patience lets them run."""
    train, _, _ = assembled(spark, sf_dir)
    return search.cv_rounds(train, replace(DEEP, rounds=700, patience=50), folds=3)


@query("rf_score")
def rf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = assembled(spark, sf_dir)
    with frame.cached(train) as rows:
        model = trees.random_forest().fit(rows)
    return regression_scores(model, test)


@query("extra_trees_approx")
def extra_trees_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred trees with random thresholds."""
    train, test, _ = assembled(spark, sf_dir)
    return regression_scores(random_trees.RandomTrees().fit(train), test)


@query("tree_score")
def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single tree and bagged trees side by side."""
    train, test, _ = assembled(spark, sf_dir)
    with frame.cached(train) as rows:
        single = trees.single_tree().fit(rows)
        bagged = trees.bagged_trees().fit(rows)
    one = single.setPredictionCol("tree").transform(test)
    return bagged.setPredictionCol("bagged").transform(one).select("ID", "tree", "bagged")


@query("adaboost_score")
def adaboost_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 300 boosted trees; boosting ends before where a tree is no better than chance."""
    train, test, _ = assembled(spark, sf_dir)
    return regression_scores(adaboost.fit_adaboost(train, rounds=300), test)


@query("lasso_cv")
def lasso_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, _ = assembled(spark, sf_dir)
    return regression_scores(others.lasso_cv(train), test)


@query("huber_regress")
def huber_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huber's loss on a linear model and on boosted trees."""
    train, test, _ = assembled(spark, sf_dir)
    with frame.cached(train) as rows:
        linear = others.huber_regression().fit(rows)
    one = linear.setPredictionCol("huber").transform(test)
    return boosting.score(boosting.fit(train, HUBER), one, "boosted").select("ID", "huber", "boosted")


@query("mlp_score")
def mlp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ReLU layers with dropout and limited weights, up to 50 epochs, stopped on held rows."""
    train, test, features = assembled(spark, sf_dir)
    return trees.score_classifier(network.deep(len(features)).fit(train), test)


@query("mlp_kfold")
def mlp_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the network on each of five folds, with mean and deviation."""
    train, _, features = assembled(spark, sf_dir)
    aucs = search.kfold_auc(train, lambda: network.deep(len(features)), 5)
    return metrics.fold_summary(aucs, "auc")


SLOTS = 1 << 20
MACHINE_EPOCHS, MACHINE_BATCHES = 5, 2


def _machine_scores(spark: SparkSession, sf_dir: str, m: factorise.Machine) -> DataFrame:
    columns = [*schema.CATEGORIES, "tweekday", "thour"]
    table = factorise.slots(prep.prepare(samples.impressions(spark, sf_dir)), columns, SLOTS)
    table = materialize(table.select("ID", "split", F.col("click").cast("double").alias("y"), "x"), "slots", ("split",))
    fit_rows, valid = split.train_valid_split(table.where("split = 'train'"), 0.1)
    model = factorise.fit(fit_rows, m, MACHINE_EPOCHS, MACHINE_BATCHES, valid)
    return factorise.score(table.where("split = 'test'"), model.weights, m)


@query("fm_fit")
def fm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine on a million hashed slots, the epoch with the best validation loss kept."""
    return _machine_scores(spark, sf_dir, factorise.Machine(rule="adam", rate=0.05, l2_factors=1e-4))


@query("fm_sparse")
def fm_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine on hashed categories: its own scores, and those of its exported weight table."""
    columns = [*schema.CATEGORIES, "tweekday", "thour"]
    imps = prep.prepare(samples.impressions(spark, sf_dir))
    table = materialize(imps.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}), "rows", ("split",))
    with frame.cached(frame.train_part(table)) as rows:
        model = others.sparse_factorisation_machine(columns, rounds=30).fit(rows)
    test = frame.test_part(table)
    weights, bias = others.export_factors(model, table)
    weights = readers.read_weights(spark, writers.write_weights(weights, new_path(spark, "weights")))
    slots = others.sparse_slots(model, test)
    by_table = sparse.fm_score(slots, weights, "ID", len(weights.first().v), bias)
    own = trees.score_classifier(model, test)
    both = own.join(by_table.select("ID", fn.sigmoid(F.col("score")).alias("click_table")), "ID")
    return rounded(both, "click", "click_table", digits=9)


@query("fm_regress")
def fm_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fitted to the label as a number, by squared error and Nesterov's momentum."""
    return _machine_scores(spark, sf_dir, factorise.Machine(loss="squared", rate=0.05, l2_factors=1e-4))


def _nb_sql(columns: str) -> str:
    """Bernoulli naive Bayes with a smoothed prior, over every model feature above 0.

    A code is above 0 unless its value is the smallest; a count always is.
    """
    coded = {"browserid", "countrycode", "devid"}
    plain = {"category", "merchant", "offerid", "siteid", "thour", "tminute", "tweekday"}
    names = sorted(coded | plain | set(counts.FEATURE_SETS[6]))

    def above(c: str) -> str:
        test = f"{c} > (SELECT min({c}) FROM prep)" if c in coded else f"{c} > 0" if c in plain else "true"
        return f"CASE WHEN {test} THEN 1 ELSE 0 END AS {c}"

    on = ", ".join(f"sum({c}) AS on_{c}" for c in names)
    share = "(m.on_{c} + 1) / CAST(m.n + 2 AS DOUBLE)"
    terms = " + ".join(
        f"ln(CASE WHEN t.{c} = 1 THEN {share.format(c=c)} ELSE 1 - {share.format(c=c)} END)" for c in names
    )
    return f"""WITH {PREP}, codes AS (SELECT ID, CAST(dense_rank() OVER (ORDER BY browserid) - 1 AS DOUBLE) AS browser FROM prep),
    f AS (SELECT ID, split, click, {", ".join(above(c) for c in names)} FROM prep),
    m AS (SELECT click, count(*) AS n, {on} FROM f WHERE split = 'train' GROUP BY click),
    j AS (SELECT t.ID, m.click AS k, ln((m.n + 1) / CAST((SELECT sum(n) FROM m) + 2 AS DOUBLE)) + {terms} AS l
      FROM f t, m WHERE t.split = 'test'),
    w AS (SELECT ID, max(l) FILTER (WHERE k = 0) AS l0, max(l) FILTER (WHERE k = 1) AS l1 FROM j GROUP BY ID)
    SELECT ID, {columns} FROM w JOIN codes USING (ID)"""


_P1 = "round(1 / (1 + exp(l0 - l1)), 6)"


@query("bernoulli_nb_ml", _nb_sql(f"{_P1} AS probability, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS click"))
def bernoulli_nb_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard classes and probabilities of Spark's own Bernoulli naive Bayes."""
    train, test, _ = assembled(spark, sf_dir)
    with frame.cached(train) as rows:
        model = search.bernoulli_pipeline().fit(rows)
    scored = model.transform(test).select(
        "ID", frame.click_probability().alias("probability"), F.col("prediction").cast("int").alias("click")
    )
    return rounded(scored, "probability")


@query("model_roundtrip", _nb_sql(f"{_P1} AS click, {_P1} AS click_loaded"))
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model and of its saved and reloaded copy."""
    train, test, _ = assembled(spark, sf_dir)
    with frame.cached(train) as rows:
        model = search.bernoulli_pipeline().fit(rows)
    path = new_path(spark, "model")
    model.write().save(path)
    loaded = trees.score_classifier(PipelineModel.load(path), test).withColumnRenamed("click", "click_loaded")
    return rounded(trees.score_classifier(model, test).join(loaded, "ID"), "click", "click_loaded")


@query(
    "stacking_features",
    _nb_sql(
        f"""19 AS width, CASE WHEN l1 > l0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction,
        round(1 / (1 + exp(l1 - l0)), 6) AS p0, {_P1} AS p1, browser AS first_feature"""
    ),
)
def stacking_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction and class probabilities prepended to the features, as columns."""
    train, test, _ = assembled(spark, sf_dir)
    with frame.cached(train) as rows:
        model = stacking.StackingEstimator(search.bernoulli_pipeline(), "wide").fit(rows)
    widened = model.transform(test).withColumn("w", vector_to_array("wide"))
    columns = widened.select(
        "ID",
        F.size("w").alias("width"),
        F.col("w")[0].alias("prediction"),
        F.col("w")[1].alias("p0"),
        F.col("w")[2].alias("p1"),
        F.col("w")[3].alias("first_feature"),
    )
    return rounded(columns, "p0", "p1")


@query("stack_fit")
def stack_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest, trees with random thresholds, LASSO with a chosen penalty and Huber's boosting, each out of fold."""
    train, test, _ = assembled(spark, sf_dir)
    levels = [trees.random_forest(), random_trees.RandomTrees(), others.LassoCV()]
    _, (scored,) = stacking.fit_stack(train, [test], levels, boosting.BoostingStage(STACK_HUBER), folds=STACK_FOLDS)
    return scored.select("ID", F.col("prediction").alias("click"))


@query("stack_in_sample")
def stack_in_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest, random trees, then LASSO, each fitted on in-sample predictions of those before."""
    train, test, _ = assembled(spark, sf_dir)
    last = others.LinearRegression(elasticNetParam=1.0, regParam=1e-3)
    with frame.cached(train) as rows:
        model = stacking.in_sample_pipeline([trees.random_forest(), random_trees.RandomTrees()], last).fit(rows)
    return regression_scores(model, test)


@query("stack_roundtrip")
def stack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test scores of a stack of forest, random trees, network and boosted trees, and of the stack saved and read again."""
    train, test, features = assembled(spark, sf_dir)
    # The same kinds of stages as in the larger stacks; what is saved does not depend on how many trees there are.
    levels = [trees.random_forest(10), random_trees.RandomTrees(random_trees.Random(10)), network.deep(len(features), 5)]
    with frame.cached(train) as rows:
        model = stacking.in_sample_pipeline(levels, boosting.BoostingStage(replace(EARLY, rounds=5, patience=None))).fit(rows)
    path = new_path(spark, "stack")
    model.write().save(path)
    loaded = trees.score_classifier(PipelineModel.load(path), test).withColumnRenamed("click", "click_loaded")
    return trees.score_classifier(model, test).join(loaded, "ID")


@query("stack_and_blend")
def stack_and_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked and boosted scores of the test rows, blended by ID."""
    train, test, _ = assembled(spark, sf_dir)
    _, (stacked,) = stacking.fit_stack(train, [test], [trees.random_forest()], random_trees.RandomTrees(), folds=STACK_FOLDS)
    boosted = boosting.score(boosting.fit(train, BAGGED), test).select("ID", "click")
    parts = [
        (stacked.select("ID", F.col("prediction").alias("click")), ensemble.STACK_WEIGHT),
        (boosted, ensemble.BOOST_WEIGHT),
    ]
    return ensemble.blend(parts)


@query("grid_search")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, _ = assembled(spark, sf_dir)
    boost = trees.Boost(rounds=4).classifier()
    grid = ParamGridBuilder().addGrid(boost.maxDepth, [2, 4]).addGrid(boost.stepSize, [0.1, 0.3]).build()
    report = search.grid_report(search.grid_search(train, boost, grid, folds=5))
    return spark.createDataFrame(report, "setting string, mean_auc double, std_auc double")


@query("model_search")
def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pipeline of the grid, fitted on all rows; no sample decides which are left."""
    train, _, _ = assembled(spark, sf_dir)
    fit_rows, valid = split.train_valid_split(train, 0.25, seed=42)
    found = search.halving(fit_rows, valid, search.space(seed=42), samples=False)
    return spark.createDataFrame(found.log, "rung int, model string, rows long, auc double")
