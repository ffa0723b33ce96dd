"""Every query without SQL runs over the sample tables and gives sane scores."""

from __future__ import annotations

import oracle
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from clickloom.models import boosting, frame, others, search, stacking
from clickloom.operators.split import add_fold

WITHOUT_SQL = sorted(set(oracle.QUERIES) - set(oracle.ORACLE))


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, name):
    rows = oracle.QUERIES[name](spark, SMALL).collect()
    assert rows
    for r in rows:
        for c in ("click", "auc", "AUC", "mean_auc"):
            if c in r.asDict() and name not in ("lasso_cv", "huber_regress", "stack_fit", "stack_in_sample", "fm_regress"):
                assert -0.5 <= r[c] <= 1.5


def test_a_loaded_stack_scores_like_the_saved_one(spark):
    rows = oracle.QUERIES["stack_roundtrip"](spark, SMALL)
    gap = rows.agg(F.max(F.abs(F.col("click") - F.col("click_loaded"))), F.count("*"), F.countDistinct("click")).first()
    assert gap[0] < 1e-12 and gap[1] > 100 and gap[2] > 10


def test_exported_factors_score_like_the_model(spark):
    gap = oracle.QUERIES["fm_sparse"](spark, SMALL).agg(F.max(F.abs(F.col("click") - F.col("click_table"))), F.count("*")).first()
    assert gap[0] < 1e-6 and gap[1] > 100


def test_boosting_queries_have_the_settings_of_the_originals(spark, monkeypatch):
    """Rounds, step, depth, bagging; the base score is the mean label."""
    seen = []

    def settings(train, given, *_):
        seen.append((given.rounds, given.step, given.loss, given.growth.depth, given.growth.row_share, given.growth.feature_share))
        assert given.base_score is None
        return boosting.Boosted(given, boosting.Bins([]), 0.0, [], [])

    monkeypatch.setattr(boosting, "fit", settings)
    for name in ("gbt_score", "gbt_regress"):
        oracle.QUERIES[name](spark, SMALL)
    assert seen == [(2000, 0.005, "logistic", 30, 0.95, 0.4), (1300, 0.1, "squared", 20, 0.95, 0.4)]
    monkeypatch.setattr(search, "cv_rounds", lambda train, given, folds: seen.append((given.rounds, given.patience, given.growth.depth, given.step, folds)))
    oracle.QUERIES["cv_rounds"](spark, SMALL)
    assert seen[2] == (700, 50, 30, 0.005, 3)


def test_stack_has_the_settings_of_the_original(spark, monkeypatch):
    """Trees of each level, a penalty chosen on folds, and rounds and step of the last level."""
    seen = []

    def levels(train, tests, levels, last, folds):
        forest, random, lasso = levels
        seen.append((forest.getNumTrees(), random.settings.trees, len(lasso.penalties), lasso.folds, last.settings.rounds, last.settings.step))
        return None, [tests[0].withColumn("prediction", F.lit(0.0))]

    monkeypatch.setattr(stacking, "fit_stack", levels)
    oracle.QUERIES["stack_fit"](spark, SMALL)
    assert seen == [(250, 100, 4, 3, 100, 0.001)]


def test_a_penalty_is_chosen_inside_the_folds_of_a_stack(spark):
    """Folds of the stack's own seed would leave one of three empty."""
    rows = spark.range(300).select(F.col("id").cast("string").alias("ID"), (F.col("id") % 7).cast("double").alias("x"))
    train = add_fold(frame.assemble(rows.withColumn("label", 2 * F.col("x")), ["x"]), 3)
    _, (scored,) = stacking.fit_stack(train, [train], [others.LassoCV([1e-3, 5.0])], others.LinearRegression(), 3)
    gap = scored.agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert gap < 0.1
