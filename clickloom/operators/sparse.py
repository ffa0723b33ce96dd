"""Sparse rows: dimensions, linear scores and factorisation-machine scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import scalar as fn
from clickloom.operators.lookup import DEFAULT_LIMITS, JoinLimits, lookup_join


def to_long(df: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
    """One row per entry: the kept columns, ``idx`` and ``value``."""
    return df.select(*keep, F.explode(features).alias("f")).select(*keep, "f.idx", "f.value")


def _entries(df: DataFrame, row_key: str, features: str = "features") -> DataFrame:
    """Entries for scoring; a row without any keeps one empty entry.

    The outer form also keeps Catalyst from testing the array's size below, where it would
    compute the array a second time.
    """
    return df.select(row_key, F.explode_outer(features).alias("f")).select(
        row_key, "f.idx", F.coalesce("f.value", F.lit(0.0)).alias("value")
    )


def sparse_dims(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows and number of features, the highest index plus one."""
    highest = F.array_max(F.transform(features, lambda f: f["idx"]))
    return df.agg(F.count("*").alias("n_rows"), (F.max(highest) + 1).alias("n_features"))


def linear_score(
    df: DataFrame,
    weights: DataFrame,
    row_key: str,
    bias: float = 0.0,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(row key, score)`` with the sum of weight times value; unknown indices add 0.

    The entries of a row stay in its task, so they are summed before the shuffle.
    """
    known = lookup_join(_entries(df, row_key), weights.select("idx", "w"), ["idx"], "left", limits=limits)
    term = F.coalesce(F.col("w"), F.lit(0.0)) * F.col("value")
    return known.groupBy(row_key).agg((F.sum(term) + bias).alias("score"))


def fm_score(
    df: DataFrame,
    weights: DataFrame,
    row_key: str,
    factors: int,
    bias: float = 0.0,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Factorisation-machine score of sparse rows, linear in their length.

    Per factor f the pair terms are half of (sum v x)^2 - sum (v x)^2.
    """
    known = lookup_join(_entries(df, row_key), weights.select("idx", "w", "v"), ["idx"], "left", limits=limits)
    x = F.col("value")
    terms = [F.coalesce(F.col("v")[f], F.lit(0.0)) * x for f in range(factors)]
    sums = known.groupBy(row_key).agg(
        F.sum(F.coalesce(F.col("w"), F.lit(0.0)) * x).alias("linear"),
        *[F.sum(t).alias(f"s{f}") for f, t in enumerate(terms)],
        *[F.sum(t * t).alias(f"q{f}") for f, t in enumerate(terms)],
    )
    pairs = fn.total([F.col(f"s{f}") * F.col(f"s{f}") - F.col(f"q{f}") for f in range(factors)])
    return sums.select(row_key, (F.col("linear") + 0.5 * pairs + bias).alias("score"))


def fm_score_fields(
    df: DataFrame,
    tables: dict[str, DataFrame],
    row_key: str,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Factorisation machine over categorical fields as a sum of embedding dot products.

    ``tables`` holds ``(field value, w, v)`` per field; an unknown value adds nothing.
    Returns the score and its sigmoid.
    """
    fields = list(tables)
    out = df.select(row_key, *fields)
    for c, t in tables.items():
        side = t.select(c, F.col("w").alias(f"_w_{c}"), F.col("v").alias(f"_v_{c}"))
        out = lookup_join(out, side, [c], "left", limits=limits)
    dots: list[Column] = [
        F.coalesce(fn.dot(F.col(f"_v_{a}"), F.col(f"_v_{b}")), F.lit(0.0))
        for i, a in enumerate(fields)
        for b in fields[i + 1 :]
    ]
    linear = [F.coalesce(F.col(f"_w_{c}"), F.lit(0.0)) for c in fields]
    scored = out.select(row_key, fn.total(dots + linear).alias("score"))
    return scored.withColumn("click", fn.sigmoid(F.col("score")))
