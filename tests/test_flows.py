"""Whole runs from CSV to submission."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from clickloom.models import boosting, trees
from clickloom.models.grow import Growth
from clickloom.models.online import FtrlModel
from clickloom.operators import prep
from clickloom.plans import flows
from clickloom.session import new_path
from clickloom.sources import readers, writers

BOOST = trees.Boost(rounds=4, bins=256)


@pytest.fixture(scope="module")
def inputs(spark, learnable):
    train = writers.write_csv(learnable.where("split = 'train'").drop("split"), new_path(spark, "train"))
    test = writers.write_csv(learnable.where("split = 'test'").drop("split", "click"), new_path(spark, "test"))
    return flows.Inputs(train, test, new_path(spark, "out"), n_counts=3, valid=0.25)


def check(spark, run, learnable, floor=0.5):
    """One finite score per test row, in a folder named after its validation score."""
    got = readers.read_predictions(spark, run.path)
    want = learnable.where("split = 'test'")
    assert got.count() == want.count() == got.join(want, "ID").count()
    assert got.where("click IS NULL OR isnan(click)").count() == 0
    assert run.metrics.get("auc", run.metrics.get("train_auc")) > floor


@pytest.mark.parametrize(
    "run,floor",
    [
        (lambda s, i: flows.boosted(s, i, BOOST), 0.7),
        (lambda s, i: flows.categorical(s, i, BOOST), 0.7),
        (lambda s, i: flows.bayes(s, i), 0.4),
        (lambda s, i: flows.factorisation_machine(s, i), 0.5),
        (lambda s, i: flows.best_candidate(s, i), 0.7),
        (lambda s, i: flows.online(s, i, ["category", "devid"], epochs=1, batches=4, interactions=True), 0.7),
    ],
    ids=["boosted", "categorical", "bayes", "fm", "candidates", "online"],
)
def test_run(spark, inputs, learnable, run, floor):
    check(spark, run(spark, inputs), learnable, floor)


def test_early_stop_run(spark, inputs, learnable):
    settings = boosting.Boosting(rounds=6, patience=2, growth=Growth(depth=5))
    run, used = flows.boosted_early_stop(spark, replace(inputs, save=new_path(spark, "models")), settings)
    check(spark, run, learnable, 0.7)
    assert set(run.metrics) == {"auc", "ap", "precision", "recall", "rounds"}
    assert used.first().splits > 0


def test_runs_save_their_models(spark, inputs, learnable):
    """A saved model, read again, gives the scores that the run wrote."""
    kept = replace(inputs, save=new_path(spark, "models"))
    run = flows.online(spark, kept, ["category", "devid"], epochs=1, batches=2, interactions=True)
    model = FtrlModel.load(f"{kept.save}/ftrl")
    test = prep.prepare(learnable.where("split = 'test'"))
    both = readers.read_predictions(spark, run.path).join(model.transform(test).select("ID", "p"), "ID")
    gap = both.agg(F.max(F.abs(F.col("click") - F.col("p"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == test.count()
    again = flows.online(spark, kept, ["category", "devid"], epochs=1, batches=2, interactions=True)
    assert again.path == run.path
    flows.boosted_early_stop(spark, kept, boosting.Boosting(rounds=2, patience=2, growth=Growth(depth=2)))
    assert len(boosting.BoostedStage.load(f"{kept.save}/early-stop").model.trees) == 2


def test_blended_run(spark, inputs, learnable):
    runs = flows.blended(spark, inputs, BOOST, forest=4, extra=2, folds=2)
    for run in runs.values():
        check(spark, run, learnable, 0.7)
    out = flows.merged(spark, runs["stacked"].path, runs["boosted"].path, new_path(spark, "merged"), (0.0, 1.0))
    passed = readers.read_predictions(spark, out).withColumnRenamed("click", "c")
    same = passed.join(readers.read_predictions(spark, runs["boosted"].path), "ID")
    assert same.where(F.abs(F.col("c") - F.col("click")) > 1e-12).count() == 0


def test_scaled_and_sampled(spark, inputs, learnable):
    half = flows.Inputs(inputs.train, inputs.test, inputs.out, n_counts=0, sample=0.5, valid=0.2, scaled=True)
    check(spark, flows.perceptron(spark, half, batch=50, shard_rows=1000, rate=0.005), learnable, 0.65)


def test_tuned_run(spark, inputs, learnable):
    run = flows.tuned(spark, inputs, BOOST, depths=[1, 4], steps=[0.1], folds=2)
    check(spark, run, learnable, 0.7)
    assert run.metrics["cv_auc"] > 0.7


def test_perceptron_over_folds(spark, inputs, learnable):
    run = flows.perceptron_folds(spark, inputs, folds=2, epochs=20, batch=50, shard_rows=1000, rate=0.005)
    check(spark, run, learnable, 0.55)
    assert run.metrics["std_auc"] >= 0


def test_online_run_with_holdout(spark, inputs, learnable):
    run = flows.online(spark, inputs, ["category", "devid"], epochs=1, batches=3, holdout_every=5, interactions=True)
    check(spark, run, learnable, 0.7)
    assert 0 < run.metrics["held_loss"] < 1


def test_label_and_id_cannot_be_hashed(spark, inputs):
    with pytest.raises(ValueError):
        flows.online(spark, inputs, ["ID", "category"])
