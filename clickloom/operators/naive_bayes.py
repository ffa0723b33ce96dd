"""Bernoulli naive Bayes in closed form: one aggregate to fit, columns to score."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import scalar as fn


@dataclass(frozen=True)
class BernoulliNB:
    """Fitted log probabilities; two numbers per class and feature."""

    features: list[str]
    prior: dict[int, float]
    log_on: dict[int, dict[str, float]]
    log_off: dict[int, dict[str, float]]
    threshold: float

    def joint(self, k: int) -> Column:
        """Log of the class prior times the likelihood of a row's binary features."""
        terms = [
            F.when(F.col(c) > self.threshold, F.lit(self.log_on[k][c])).otherwise(F.lit(self.log_off[k][c]))
            for c in self.features
        ]
        return fn.total([F.lit(self.prior[k]), *terms])

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the click probability and the hard class."""
        scored = df.withColumns({"_l0": self.joint(0), "_l1": self.joint(1)})
        return scored.withColumns(
            {
                "probability": fn.sigmoid(F.col("_l1") - F.col("_l0")),
                "prediction": (F.col("_l1") > F.col("_l0")).cast("int"),
            }
        ).drop("_l0", "_l1")


def fit_bernoulli_nb(
    df: DataFrame,
    features: list[str],
    label: str = "click",
    alpha: float = 1.0,
    fit_prior: bool = True,
    threshold: float = 0.0,
) -> BernoulliNB:
    """Fit from per-class counts of features above the threshold, smoothed by ``alpha``."""
    on = [F.sum((F.col(c) > threshold).cast("bigint")).alias(f"on_{c}") for c in features]
    other = df.where(~F.col(label).isin(0, 1) | F.col(label).isNull())
    if not other.isEmpty():
        raise ValueError(f"only classes 0 and 1 are known, found {other.first()[label]}")
    per_class = df.groupBy(label).agg(F.count("*").alias("rows"), *on)
    counts = {r[label]: r for r in per_class.collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"both classes 0 and 1 are needed, found {list(counts)}")
    rows = sum(r["rows"] for r in counts.values())
    prior, log_on, log_off = {}, {}, {}
    for k, r in counts.items():
        prior[k] = log(r["rows"] / rows) if fit_prior else log(0.5)
        share = {c: (r[f"on_{c}"] + alpha) / (r["rows"] + 2 * alpha) for c in features}
        log_on[k] = {c: log(p) for c, p in share.items()}
        log_off[k] = {c: log(1.0 - p) for c, p in share.items()}
    return BernoulliNB(list(features), prior, log_on, log_off, threshold)
