"""Exact click metrics on scored rows, per group if asked.

Rows are first collapsed to one per distinct score, so ties cost nothing and no score,
however frequent, stays in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import scalar as fn
from clickloom.operators.ordinal import running_totals
from clickloom.session import materialize


def score_ladder(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct ``score``: positives ``p``, negatives ``n`` and, counted from
    the highest score down and including this one, ``tp`` and ``fp``.

    The scored rows, often a model's output, are computed once; the rest reads the steps.
    """
    hit = F.col(label).cast("bigint")
    rows = df.select(*by, F.col(score).alias("score"), hit.alias("_hit"))
    steps = rows.groupBy(*by, "score").agg(F.sum("_hit").alias("p"), F.sum(1 - F.col("_hit")).alias("n"))
    return running_totals(
        materialize(steps, "steps"), ["score"], {"tp": F.col("p"), "fp": F.col("n")}, by, descending=True
    )


def roc_auc(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve with ties shared; null if a class is missing."""
    ladder = score_ladder(df, score, label, by)
    pairs = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))
    both = F.sum("p").cast("double") * F.sum("n")
    return ladder.groupBy(*by).agg(fn.safe_ratio(pairs, both).alias("auc"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC points ``(threshold, fpr, tpr)``, one per distinct score.

    The origin, where nothing is predicted positive, has no threshold.
    """
    ladder = score_ladder(df, score, label)
    sums = ladder.agg(F.sum("p").alias("P"), F.sum("n").alias("N")).first()
    p, n = (float(sums["P"]) if sums["P"] else None), (float(sums["N"]) if sums["N"] else None)
    points = ladder.select(
        F.col("score").cast("double").alias("threshold"),
        (F.col("fp") / F.lit(n).cast("double")).alias("fpr"),
        (F.col("tp") / F.lit(p).cast("double")).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], points.schema)
    return points.unionByName(origin)


def trapezoid_area(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC points by the trapezoid rule."""
    ladder = score_ladder(df, score, label, by)
    slices = F.sum(F.col("n") * (F.col("tp") + F.col("tp") - F.col("p")) / 2.0)
    both = F.sum("p").cast("double") * F.sum("n")
    return ladder.groupBy(*by).agg(fn.safe_ratio(slices, both).alias("area"))


def average_precision(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Step sum of precision over recall; null without positives."""
    ladder = score_ladder(df, score, label, by)
    steps = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return ladder.groupBy(*by).agg(fn.safe_ratio(steps, F.sum("p")).alias("ap"))


def threshold_metrics(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and accuracy of the score rounded half to even."""
    hit, y = F.rint(score) == 1, F.col(label) == 1

    def rows(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    tp, fp, missed = rows(hit & y), rows(hit & ~y), rows(~hit & y)
    return df.groupBy(*by).agg(
        fn.safe_ratio(tp.cast("double"), tp + fp, 0.0).alias("precision"),
        fn.safe_ratio(tp.cast("double"), tp + missed, 0.0).alias("recall"),
        F.avg((hit == y).cast("double")).alias("accuracy"),
    )


def loss_metrics(df: DataFrame, prob: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean losses of a probability, and the R2 it would have as a regression."""
    p, y = F.col(prob), F.col(label).cast("double")
    y_pm1 = F.when(y == 0, F.lit(-1.0)).otherwise(y)
    spread = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg(
        F.avg(fn.log_loss(p, y)).alias("logloss"),
        F.avg(fn.cross_entropy(p, y)).alias("cross_entropy"),
        F.avg(fn.margin_loss(p, y_pm1)).alias("margin_loss"),
        F.avg(fn.squared_error(p, y)).alias("mse"),
        F.avg(fn.exp_abs_error(p, y)).alias("exp_mae"),
        (1.0 - fn.safe_ratio(F.sum(fn.squared_error(p, y)), spread)).alias("r2"),
    )


def fold_summary(scores: DataFrame, metric: str) -> DataFrame:
    """Mean and population deviation of a metric over folds."""
    return scores.agg(
        F.count(metric).alias("folds"),
        F.avg(metric).alias(f"mean_{metric}"),
        F.stddev_pop(metric).alias(f"std_{metric}"),
    )


def scalar(frame: DataFrame) -> float:
    """The one number of a one-row, one-column metric frame."""
    return frame.first()[0]


# Columns of a block: a task holds the sums of one pair of blocks at a time.
BLOCK = 64
# Rows of a batch that are multiplied at once.
GRAM_ROWS = 8192


def correlation_pairs(df: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Pearson correlation of every column pair once, ``(feature_a, feature_b, corr)``.

    Rows where both columns are present count; a column without spread correlates with nothing (null). Columns are centred
    by their means first, so that moments keep their digits. Tasks multiply their rows by blocks of columns, with a mask of
    what is present, and the products of a pair of blocks meet in one row.
    """
    # Read twice, for the means and for the products.
    x = materialize(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]), "columns")
    means = [m or 0.0 for m in x.agg(*[F.avg(F.nanvl(c, F.lit(None))) for c in x.columns]).first() or []]
    parts = x.mapInArrow(lambda batches: _block_products(batches, means, block), "a int, b int, sums binary")
    # Pairs without any row have no correlation, but a place in the result.
    starts = range(-(-len(columns) // block))
    nothing = df.sparkSession.createDataFrame([(i, j, b"") for i in starts for j in starts[i:]], "a int, b int, sums binary")
    parts = parts.unionByName(nothing)
    schema = "a int, b int, feature_a string, feature_b string, corr double"
    names = list(columns)
    met = parts.groupBy("a", "b").applyInArrow(lambda key, table: _block_correlations(key, table, names, block), schema)
    return met.select("feature_a", "feature_b", "corr")


def _block_products(batches: Iterable[pa.RecordBatch], means: list[float], block: int) -> Iterator[pa.RecordBatch]:
    """Per pair of column blocks: rows, sums, squares and products over the rows where both columns are present."""
    starts = range(0, len(means), block)
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, GRAM_ROWS):
            rows = batch.slice(at, GRAM_ROWS)
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in rows.columns], 1) - means
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(np.float64)
            for i, a in enumerate(starts):
                xa, ma = x[:, a : a + block], there[:, a : a + block]
                for j, b in enumerate(starts[i:], i):
                    xb, mb = x[:, b : b + block], there[:, b : b + block]
                    new = np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb])
                    sums[i, j] = sums[i, j] + new if (i, j) in sums else new
    for (i, j), total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["a", "b", "sums"]
        )


def _block_correlations(key: tuple, table: pa.Table, columns: list[str], block: int) -> pa.Table:
    i, j = (k.as_py() for k in key)
    left, right = columns[i * block : (i + 1) * block], columns[j * block : (j + 1) * block]
    # Sorted, so that sums do not depend on the order of arrival.
    parts = sorted(table.column("sums").to_pylist())
    zero = np.zeros((6, len(left), len(right)))
    n, sx, sy, sxx, syy, sxy = sum((np.frombuffer(p).reshape(zero.shape) for p in parts if p), zero)
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy, cov = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        # What rounding leaves of a column without spread is none.
        flat = (vx <= 1e-13 * sxx) | (vy <= 1e-13 * syy) | (n == 0)
        corr = np.where(flat, np.nan, cov / np.sqrt(np.where(flat, 1.0, vx * vy)))
    picked = [(a, b) for a in range(len(left)) for b in range(len(right)) if i < j or a < b]
    values = np.array([corr[a, b] for a, b in picked], np.float64)
    return pa.table(
        {
            "a": pa.array([i] * len(picked), pa.int32()), "b": pa.array([j] * len(picked), pa.int32()),
            "feature_a": pa.array([left[a] for a, _ in picked], pa.string()), "feature_b": pa.array([right[b] for _, b in picked], pa.string()),
            "corr": pa.array(values, mask=np.isnan(values)),
        }
    )
