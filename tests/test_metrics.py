from __future__ import annotations

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clickloom.operators import ensemble, logs, metrics, ordinal
from clickloom.sources import samples


@pytest.fixture(scope="module")
def ties(spark):
    rows = [(0.2, 0), (0.2, 1), (0.5, 0), (0.5, 1), (0.5, 1), (0.9, 1)]
    return spark.createDataFrame(rows, "score double, y int")


def one(df):
    return metrics.scalar(df)


def test_ties_by_hand(ties):
    # Of 8 positive/negative pairs: 0.9 wins 2, 0.5 wins 2 and ties 2, 0.2 ties 1.
    assert one(metrics.roc_auc(ties, "score", "y")) == pytest.approx((2 + 2 + 1 + 0.5) / 8)
    assert one(metrics.trapezoid_area(ties, "score", "y")) == pytest.approx(5.5 / 8)
    # Precision 1 over 1 positive, 3/4 over 2, 4/6 over 1.
    assert one(metrics.average_precision(ties, "score", "y")) == pytest.approx((1 + 2 * 0.75 + 4 / 6) / 4)


def test_roc_points(ties):
    points = {r.threshold: (r.fpr, r.tpr) for r in metrics.roc_points(ties, "score", "y").collect()}
    assert points == {None: (0.0, 0.0), 0.9: (0.0, 0.25), 0.5: (0.5, 0.75), 0.2: (1.0, 1.0)}


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.7, 1)], "score double, y int")
    assert one(metrics.roc_auc(df, "score", "y")) is None
    assert one(metrics.average_precision(df, "score", "y")) == pytest.approx(1.0)
    assert metrics.roc_points(df, "score", "y").where("threshold is not null").select("fpr").first()[0] is None
    negatives = df.withColumn("y", F.lit(0))
    assert one(metrics.average_precision(negatives, "score", "y")) is None
    got = metrics.threshold_metrics(negatives, "score", "y").first()
    assert (got.precision, got.recall, got.accuracy) == (0.0, 0.0, 0.5)


def test_half_rounds_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "p double")
    assert [r[0] for r in df.select(F.rint("p")).collect()] == [0.0, 2.0, 2.0]
    hits = spark.createDataFrame([(0.5, 1), (0.51, 1)], "p double, y int")
    assert metrics.threshold_metrics(hits, "p", "y").first().recall == 0.5


def test_equals_spark_evaluator(imps, monkeypatch):
    monkeypatch.setattr(ordinal, "BUCKET_ROWS", 8)
    df = samples.with_scores(imps).withColumn("score", F.col("score_a") + F.rand(3))
    df = df.withColumn("raw", array_to_vector(F.array("score"))).cache()
    want = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="click", numBins=0).evaluate(
        df.withColumn("raw", F.col("score"))
    )
    assert one(metrics.roc_auc(df, "score", "click")) == pytest.approx(want, abs=1e-9)


def test_correlations_with_gaps_and_constants(spark):
    rows = [(1.0, 2.0, None, 3), (2.0, 1.0, 4.0, 3), (3.0, 5.0, 1.0, 3), (4.0, 4.5, 2.0, 3)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k int")
    got = {(r.feature_a, r.feature_b): r["corr"] for r in metrics.correlation_pairs(df, ["a", "b", "c", "k"]).collect()}
    pdf = df.toPandas()
    for (x, y), value in got.items():
        want = pdf[[x, y]].dropna().corr().iloc[0, 1]
        if "k" in (x, y):
            assert value is None
        else:
            assert value == pytest.approx(want)
    assert len(got) == 6


def test_many_columns_correlate_in_blocks(spark):
    """500 columns, blocks that do not divide them, gaps, and the same digits under any partitioning."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 500)).cumsum(1) + 1e6
    x[rng.random(x.shape) < 0.05] = np.nan
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(500)])
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"f{i} double" for i in range(500)))
    got = metrics.correlation_pairs(df.repartition(3), list(pdf.columns)).collect()
    want = pdf.corr().to_numpy()
    assert len(got) == 500 * 499 // 2
    assert max(abs(r["corr"] - want[int(r.feature_a[1:]), int(r.feature_b[1:])]) for r in got) < 1e-9
    few = list(pdf.columns[:9])
    small = {tuple(r) for r in metrics.correlation_pairs(df.select(*few).repartition(5), few, 4).collect()}
    assert {(a, b) for a, b, _ in small} == {(a, b) for i, a in enumerate(few) for b in few[i + 1 :]}


def test_correlation_survives_large_offsets(spark):
    df = spark.range(200).select(
        (1e9 + F.col("id") % 7 / 1000).alias("far"), (F.col("id") % 5).alias("near"), F.lit(1e9).alias("flat")
    )
    got = {(r.feature_a, r.feature_b): r["corr"] for r in metrics.correlation_pairs(df, ["far", "near", "flat"]).collect()}
    pdf = df.toPandas()
    pdf["far"] -= 1e9
    assert got[("far", "near")] == pytest.approx(pdf[["far", "near"]].corr().iloc[0, 1], abs=1e-4)
    assert got[("far", "flat")] is None and got[("near", "flat")] is None


def test_correlation_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert [tuple(r) for r in metrics.correlation_pairs(df, ["a", "b"]).collect()] == [("a", "b", None)]


def test_loss_metrics_by_hand(spark):
    from math import exp, log

    df = spark.createDataFrame([(0.8, 1), (0.3, 0)], "p double, y int")
    got = metrics.loss_metrics(df, "p", "y").first()
    assert got.logloss == pytest.approx(-(log(0.8) + log(0.7)) / 2)
    assert got.margin_loss == pytest.approx((log(1 + exp(-0.8)) + log(1 + exp(0.3))) / 2)
    assert got.mse == pytest.approx((0.04 + 0.09) / 2)
    assert got.exp_mae == pytest.approx(((exp(1) - exp(0.8)) + (exp(0.3) - 1)) / 2)
    assert got.r2 == pytest.approx(1 - 0.13 / 0.5)


def test_logloss_is_clipped(spark):
    df = spark.createDataFrame([(0.0, 1)], "p double, y int")
    from clickloom.functions.scalar import log_loss

    assert df.select(log_loss(F.col("p"), F.col("y"))).first()[0] == pytest.approx(32.236, abs=1e-3)


def log(spark, values, run="r"):
    return spark.createDataFrame([(run, i, v) for i, v in enumerate(values)], "run string, iter int, AUC double")


def test_early_stop(spark):
    both = log(spark, [0.5, 0.7, 0.6, 0.69, 0.9], "a").unionByName(log(spark, [0.1, 0.2, 0.3], "b"))
    got = {r.run: (r.stop_iter, r.best_iter, r.stopped) for r in logs.early_stop(both, 2).collect()}
    assert got == {"a": (3, 1, 1), "b": (2, 2, 0)}
    low = {r.run: (r.stop_iter, r.best_iter) for r in logs.early_stop(both, 2, maximise=False).collect()}
    assert low == {"a": (2, 0), "b": (2, 0)}


def test_best_iteration_takes_the_first_of_equals(spark):
    df = log(spark, [0.5, 0.8, 0.8])
    assert tuple(logs.best_iteration(df).first()) == ("r", 1, 0.8)
    assert tuple(logs.best_iteration(df, maximise=False).first()) == ("r", 0, 0.5)


def test_time_left_on_a_published_log(spark):
    # Published values: elapsed and estimated remaining time of a ten-round run.
    elapsed = [129074, 227427, 325989, 406553, 477557, 532943, 599557]
    remaining = [1161668, 909711, 760642, 609830, 477557, 355295, 256953]
    df = spark.createDataFrame(list(enumerate(elapsed)), "iter int, elapsed_ms bigint")
    got = {r["iter"]: r.remaining_ms for r in logs.time_left(df, 10).collect()}
    assert all(abs(got[i] - r) <= 1e-5 * r for i, r in enumerate(remaining))


def test_blend_is_by_key(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 0.0)], "ID string, click double")
    b = spark.createDataFrame([("y", 1.0), ("x", 0.5)], "ID string, click double")
    got = {r.ID: r.click for r in ensemble.blend([(a, 0.2855), (b, 0.7145)]).collect()}
    assert got == {"x": pytest.approx(0.2855 + 0.35725), "y": pytest.approx(0.7145)}
