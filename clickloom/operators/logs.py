"""Training-log operators: best iteration, early stop, time left, metric gap.

A log has one row per iteration of a run; logs of many runs are handled together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_iteration(log: DataFrame, metric: str = "AUC", maximise: bool = True, run: str = "run") -> DataFrame:
    """First iteration at which the metric is best, per run."""
    value = F.col(metric) if maximise else -F.col(metric)
    best = F.max(F.struct(value.alias("v"), (-F.col("iter")).alias("at")))
    return log.groupBy(run).agg(best.alias("b")).select(
        run,
        (-F.col("b.at")).alias("best_iter"),
        (F.col("b.v") if maximise else -F.col("b.v")).alias(f"best_{metric}"),
    )


def early_stop(
    log: DataFrame, patience: int, metric: str = "AUC", maximise: bool = True, run: str = "run"
) -> DataFrame:
    """Where a run would stop: the first iteration ``patience`` rounds past its best so far.

    Runs that never stop keep their last iteration.
    """
    value = F.col(metric) if maximise else -F.col(metric)
    upto = Window.partitionBy(run).orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(value.alias("v"), (-F.col("iter")).alias("at"))).over(upto)
    seen = log.withColumn("_best", best).withColumn("_since", F.col("iter") + F.col("_best.at"))
    stops = F.col("_since") >= patience
    last = F.max_by(-F.col("_best.at"), F.col("iter"))
    return seen.groupBy(run).agg(
        F.coalesce(F.min(F.when(stops, F.col("iter"))), F.max("iter")).alias("stop_iter"),
        F.coalesce(F.min_by(F.when(stops, -F.col("_best.at")), F.when(stops, F.col("iter"))), last).alias("best_iter"),
        F.max(stops.cast("int")).alias("stopped"),
    )


def time_left(log: DataFrame, iterations: int) -> DataFrame:
    """Remaining time if the iterations still to come take as long as those done."""
    done = F.col("iter") + 1
    remaining = F.col("elapsed_ms") * (F.lit(iterations) - done) / done
    return log.withColumn("remaining_ms", F.round(remaining).cast("bigint"))


def metric_gap(learn: DataFrame, test: DataFrame, metric: str = "AUC") -> DataFrame:
    """Learn minus test metric per iteration."""
    a = learn.select("iter", F.col(metric).alias("learn"))
    b = test.select("iter", F.col(metric).alias("test"))
    return a.join(b, "iter").withColumn("gap", F.col("learn") - F.col("test"))
