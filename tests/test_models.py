"""Fitted models learn a learnable label; staged and stacked scores are what they claim."""

from __future__ import annotations

import time

import pytest
from conftest import SMALL
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from clickloom.models import adaboost, boosting, frame, grow, others, random_trees, search, stacking, trees
from clickloom.operators import logs, metrics, prep, split
from clickloom.session import materialize


@pytest.fixture(scope="module")
def data(learnable):
    table = materialize(frame.model_frame(learnable, 3), "features")
    features = prep.feature_columns(table)
    wide = frame.assemble(table, features).withColumn("label", F.col("click").cast("double"))
    fit, valid = split.train_valid_split(wide.select("ID", "label", "features"), 0.3)
    return materialize(fit, "fit"), materialize(valid, "valid"), features


def auc(scored, score):
    return metrics.scalar(metrics.roc_auc(scored.withColumn("s", score), "s", "label"))


def test_boosting_beats_the_base_rate(data):
    fit, valid, _ = data
    scored = trees.fit_classifier(fit, trees.Boost(rounds=10)).transform(valid)
    assert auc(scored, frame.click_probability()) > 0.8
    rate = fit.agg(F.avg("label")).first()[0]
    loss = metrics.loss_metrics(scored.withColumn("p", frame.click_probability()), "p", "label").first().logloss
    base = metrics.loss_metrics(valid.withColumn("p", F.lit(rate)), "p", "label").first().logloss
    assert loss < base


@pytest.mark.parametrize(
    "make",
    [
        lambda d: trees.random_forest(10),
        lambda d: trees.extra_trees(10),
        lambda d: trees.bagged_trees(5),
        lambda d: trees.single_tree(),
        lambda d: trees.Boost(rounds=5, **trees.BAGGED).regressor(),
        lambda d: others.factorisation_machine(rounds=60, step=0.1),
    ],
    ids=["forest", "extra", "bagged", "tree", "regressor", "fm"],
)
def test_each_model_learns(data, make):
    fit, valid, features = data
    scored = make(len(features)).fit(fit).transform(valid)
    score = frame.click_probability() if "probability" in scored.columns else F.col("prediction")
    assert auc(scored, score) > 0.6


def test_perceptron_scores_probabilities(data):
    fit, valid, features = data
    scored = others.perceptron(len(features), rounds=5).fit(fit).transform(valid)
    low, high = scored.select(frame.click_probability().alias("p")).agg(F.min("p"), F.max("p")).first()
    assert 0 <= low <= high <= 1


def test_staged_scores_end_at_the_model(data):
    fit, valid, _ = data
    model = trees.fit_classifier(fit, trees.Boost(rounds=6))
    whole = model.transform(valid).select("ID", frame.click_probability().alias("whole"))
    staged = trees.score_rounds(model, valid, 6)
    gap = whole.join(staged, "ID").agg(F.max(F.abs(F.col("whole") - F.col("click"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == valid.count()


def test_patience_picks_the_best_round(data):
    fit, valid, _ = data
    model, rounds, log = trees.fit_with_patience(fit, valid, trees.Boost(rounds=8), patience=3)
    stop = logs.early_stop(log, 3).first()
    best = {r["iter"]: r.AUC for r in log.collect()}
    assert rounds == stop.best_iter + 1
    assert best[rounds - 1] == max(v for i, v in best.items() if i <= stop.stop_iter)
    assert auc(trees.score_rounds(model, valid, rounds).join(valid, "ID"), F.col("click")) == pytest.approx(best[rounds - 1])


def test_split_counts_find_the_used_features(spark, data):
    fit, _, features = data
    model = trees.fit_classifier(fit, trees.Boost(rounds=3))
    rows = trees.split_counts(model, spark, features).collect()
    assert {r.feature for r in rows} == set(features)
    assert max(rows, key=lambda r: r.gain).feature in {"category", "devid"}
    assert sum(r.gain for r in rows) == pytest.approx(1.0)
    assert [r.splits for r in rows] == sorted((r.splits for r in rows), reverse=True)


def test_importance_sweep(data):
    fit, valid, features = data
    rows = trees.importance_sweep(fit, valid, features, trees.Boost(rounds=3))
    assert rows[0][1] == len(features)
    assert len(rows) == len({cut for cut, _, _ in rows}) >= 3
    assert [n for _, n, _ in rows] == sorted((n for _, n, _ in rows), reverse=True)


def test_rounds_by_cross_validation(data):
    fit, _, _ = data
    log = search.cv_rounds(fit, boosting.Boosting(rounds=3, growth=grow.Growth(depth=5)), folds=2).orderBy("iter").collect()
    assert [(r["iter"], r.folds) for r in log] == [(0, 2), (1, 2), (2, 2)]
    assert log[-1].AUC > 0.7
    # With patience the rounds end where the mean has not risen for so long.
    noise = fit.withColumn("label", F.pmod(F.xxhash64("ID"), F.lit(2)).cast("double"))
    log = search.cv_rounds(noise, boosting.Boosting(rounds=50, patience=2, growth=grow.Growth(depth=2)), folds=2).orderBy("iter").collect()
    means = [r.AUC for r in log]
    assert len(means) == means.index(max(means)) + 1 + 2 < 50


def test_stacking_widens_features(data):
    fit, valid, features = data
    model = stacking.StackingEstimator(search.bernoulli_pipeline(), "wide").fit(fit)
    row = model.transform(valid).select(vector_to_array("features").alias("f"), vector_to_array("wide").alias("w")).first()
    assert len(row.w) == len(features) + 3
    assert row.w[3:] == row.f
    assert row.w[1] + row.w[2] == pytest.approx(1.0)


def test_out_of_fold_rows_never_see_their_own_model(data):
    """With one leaf per row in-sample predictions give the label away; out of fold they do not."""
    fit, _, _ = data
    noise = fit.withColumn("label", F.pmod(F.xxhash64("ID"), F.lit(2)).cast("double"))
    deep = trees.single_tree(depth=15)
    inside = stacking.StackingEstimator(deep).fit(noise).transform(noise)
    outside = stacking._out_of_fold(materialize(split.add_fold(noise, 3), "folds"), deep, 3)
    first = vector_to_array("features")[0]
    assert auc(inside, first) > 0.95
    assert 0.4 < auc(outside, first) < 0.6
    assert outside.count() == noise.count()


def test_stack_learns(data):
    fit, valid, _ = data
    last = others.LinearRegression(elasticNetParam=1.0, regParam=1e-3)
    _, (scored,) = stacking.fit_stack(fit, [valid], [trees.random_forest(5), random_trees.RandomTrees(random_trees.Random(5))], last, folds=2)
    assert auc(scored, F.col("prediction")) > 0.75
    assert scored.count() == valid.count()


def test_lasso_prefers_a_penalty(data):
    fit, _, features = data
    at = features.index("category")
    linear = fit.withColumn("label", (vector_to_array("features")[at] > 25).cast("double"))
    model = others.lasso_cv(linear, [1e-3, 10.0], folds=2)
    assert model.avgMetrics[0] < model.avgMetrics[1]


def test_grid_search_uses_exact_auc(data):
    fit, valid, _ = data
    boost = trees.Boost(rounds=2).classifier()
    grid = ParamGridBuilder().addGrid(boost.maxDepth, [1, 4]).build()
    report = search.grid_report(search.grid_search(fit, boost, grid, folds=2))
    assert report[0][0] == "maxDepth=4" and report[0][1] > report[1][1]


def test_candidates_are_ranked(data):
    fit, valid, _ = data
    ranked = search.rank_candidates(fit, valid, search.candidates(trees.Boost(rounds=3)))
    assert ranked[0][0] == "boosted"
    assert len(ranked) == 3


def test_halving_fits_fewer_rows_and_picks_alike(data):
    fit, valid, _ = data
    models = {k: v for k, v in search.space(n=99).items() if k.startswith(("bernoulli", "logistic reg=0.0 ", "boosted depth=4 rounds=5", "boosted depth=2 rounds=5"))}
    assert len(models) == 8 and list(search.space(n=5)) == list(search.space(n=99))[:5]
    found = search.halving(fit, valid, models)
    assert found.winner.startswith("boosted")
    rungs = [[name for r, name, _, _ in found.log if r == k] for k in range(3)]
    assert [len(r) for r in rungs] == [8, 2, 1] and set(rungs[2]) <= set(rungs[1])
    # Less than all candidates on all rows, and the last fit has all rows.
    assert found.rows_fitted < 0.4 * len(models) * fit.count() and found.log[-1][2] == fit.count()
    again = search.halving(fit.repartition(3), valid.repartition(5), models)
    assert again.winner == found.winner and [r[:3] for r in again.log] == [r[:3] for r in found.log]


def test_factorisation_machine_survives_saving(spark, data):
    from pyspark.ml import PipelineModel

    from clickloom.session import new_path

    fit, valid, _ = data
    model = others.factorisation_machine(rounds=3).fit(fit)
    path = new_path(spark, "fm")
    model.write().save(path)
    again = trees.score_classifier(PipelineModel.load(path), valid).withColumnRenamed("click", "again")
    both = trees.score_classifier(model, valid).join(again, "ID")
    assert both.where("click != again").count() == 0 and both.count() == valid.count()


def test_adaboost_learns_and_reweights(data):
    fit, valid, _ = data
    model = adaboost.fit_adaboost(fit, rounds=4, depth=3)
    assert len(model.trees) == len(model.weights) >= 1 and min(model.weights) > 0
    assert auc(model.transform(valid), F.col("prediction")) > 0.6


def test_weighted_median(spark):
    votes = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(w).alias("weight")) for v, w in ((3.0, 0.2), (1.0, 0.5), (2.0, 0.6))])
    assert spark.range(1).select(adaboost.weighted_median(votes, 1.3)).first()[0] == 2.0


def test_adaboost_stops_at_a_perfect_tree(spark, data):
    fit, _, features = data
    at = features.index("category")
    easy = fit.withColumn("label", (vector_to_array("features")[at] > 25).cast("double"))
    assert len(adaboost.fit_adaboost(easy, rounds=5, depth=2).trees) == 1


def test_one_more_category_changes_nothing(spark):
    """A category column is treated alike at 256, 257 and any other number of values."""

    def rates(values):
        train = spark.range(3000).select(
            F.col("id").cast("string").alias("ID"), (F.col("id") % values).cast("string").alias("c"),
            ((F.col("id") % values) % 2).cast("double").alias("label"),
        )
        rows, (other,), names = trees.with_category_rates(train, [train.select("ID", "c")], ["c"], ["c"])
        assert names == ["c", "rate_c"] and rows.count() == other.count() == 3000
        even = other.where(F.col("ID").cast("int") % values % 2 == 0).agg(F.max("rate_c")).first()[0]
        odd = other.where(F.col("ID").cast("int") % values % 2 == 1).agg(F.min("rate_c")).first()[0]
        return even < 0.5 < odd

    assert rates(256) and rates(257) and rates(1000)


def test_stack_is_saved(spark, data):
    from pyspark.ml import PipelineModel

    from clickloom.session import new_path

    fit, valid, _ = data
    extra = random_trees.RandomTrees(random_trees.Random(3))
    model = stacking.in_sample_pipeline([trees.random_forest(3), extra], trees.single_tree()).fit(fit)
    path = new_path(spark, "stack")
    model.write().save(path)
    a = model.transform(valid).select("ID", F.col("prediction").alias("a"))
    b = PipelineModel.load(path).transform(valid).select("ID", F.col("prediction").alias("b"))
    assert a.join(b, "ID").where("a <> b").count() == 0 and a.count() > 0


def test_training_tables_are_kept_in_parts_of_bounded_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("ID")).coalesce(1)
    parts = frame.dealt(df, 50).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 20 and max(r["count"] for r in parts) < 100 and sum(r["count"] for r in parts) == 1000
    # Enough parts, or no key to deal by: as it is.
    assert frame.dealt(df, 1000) is df
    bare = df.select(F.col("ID").alias("x"))
    assert frame.dealt(bare, 50) is bare


def test_importance_sweep_fits_a_set_of_features_once(data, monkeypatch):
    fit, valid, features = data
    fits, real, boost = [], GBTClassifier.fit, trees.Boost(rounds=2)
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: fits.append(1) or real(self, rows))
    found = trees.importance_sweep(fit, valid, features, boost)
    assert len(fits) == len(found)
    # As plain refits have it.
    gains = trees.fit_classifier(fit, boost).featureImportances
    for cut, n, value in (found[0], found[1]):
        keep = [i for i in range(len(features)) if gains[i] >= cut]
        slicer = VectorSlicer(inputCol="features", outputCol="kept", indices=keep)
        model = boost.classifier(featuresCol="kept").fit(slicer.transform(fit))
        plain = model.transform(slicer.transform(valid))
        assert n == len(keep) and value == pytest.approx(auc(plain, F.rint(frame.click_probability())))


class Meeting(Estimator):
    """Waits until two are being fitted, then fits naive Bayes."""

    def __init__(self, started):
        super().__init__()
        self.started = started

    def _fit(self, dataset):
        self.started.append(1)
        end = time.monotonic() + 60
        while len(self.started) < 2:
            assert time.monotonic() < end, "fitted one after another"
            time.sleep(0.05)
        return search.bernoulli_pipeline().fit(dataset)


def test_halving_fits_candidates_side_by_side(data):
    fit, valid, _ = data
    started = []
    found = search.halving(fit, valid, {"a": Meeting(started), "b": Meeting(started)})
    # Equal scores: the first name wins.
    assert found.winner == "a" and [r[:2] for r in found.log] == [(0, "a"), (0, "b"), (1, "a")]


def test_search_without_samples_fits_every_candidate_on_all_rows_once(data):
    fit, valid, _ = data
    started = []
    models = {name: Meeting(started) for name in "abcd"}
    found = search.halving(fit, valid, models, samples=False)
    assert len(started) == 4 and found.rows_fitted == 4 * fit.count()
    assert [r[:3] for r in found.log] == [(r, name, fit.count()) for r, left in enumerate(("abcd", "a", "a")) for name in left]


def test_model_search_tries_the_whole_grid(spark, monkeypatch):
    import oracle

    seen = []
    monkeypatch.setattr(search, "halving", lambda fit, valid, models, samples: seen.append((len(models), samples)) or search.Halving("", None, [(0, "", 1, 0.5)]))
    oracle.QUERIES["model_search"](spark, SMALL)
    assert seen == [(37, False)] and len(search.space(n=99)) == 37
