"""Scalar expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability clip and sigmoid bound.
PROB_EPS = 10e-15
SIGMOID_BOUND = 35.0

_HASH_SPACE = float(2**32)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def bounded_sigmoid(x: Column) -> Column:
    """Sigmoid of ``x`` held within +-35, so ``exp`` cannot overflow."""
    return sigmoid(clip(x, -SIGMOID_BOUND, SIGMOID_BOUND))


def sign_or_one(x: Column) -> Column:
    """-1 below zero, otherwise +1 (zero counts as positive, unlike ``signum``)."""
    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def total(parts: list[Column]) -> Column:
    return reduce(add, parts)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(u: Column, v: Column) -> Column:
    """Dot product of two equally long arrays of doubles."""
    return array_sum(F.zip_with(u, v, lambda a, b: a * b))


def hash32(*parts: Column) -> Column:
    """First 32 bits of the MD5 of the parts joined by ``_``, as a bigint >= 0.

    Stable across sessions, partitionings and SQL engines.
    """
    text = F.concat_ws("_", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_hash(*parts: Column, seed: int | str) -> Column:
    """Reproducible uniform number in [0, 1) for a row key."""
    return hash32(*parts, F.lit(str(seed))) / F.lit(_HASH_SPACE)


def token_index(name: str, value: Column, size: int) -> Column:
    """Slot of ``name_value`` in a table of ``size`` weights (the hashing trick)."""
    return F.pmod(hash32(F.lit(name), value), F.lit(size))


def log_loss(p: Column, y: Column) -> Column:
    """Loss of probability ``p`` for label ``y`` in {0, 1}, clipped away from 0 and 1."""
    held = clip(p, PROB_EPS, 1.0 - PROB_EPS)
    return F.when(y == 1, -F.ln(held)).otherwise(-F.ln(1.0 - held))


def margin_loss(margin: Column, y_pm1: Column) -> Column:
    """Logistic loss ``log(1 + exp(-y * margin))`` for labels -1 and +1."""
    return F.log1p(F.exp(-y_pm1 * margin))


def squared_error(p: Column, y: Column) -> Column:
    return (y - p) * (y - p)


def exp_abs_error(p: Column, y: Column) -> Column:
    """Absolute error after both sides are exponentiated (targets kept as logs)."""
    return F.abs(F.exp(y) - F.exp(p))


def cross_entropy(p: Column, y: Column) -> Column:
    """Unclipped binary cross entropy; ``p`` must lie strictly inside (0, 1)."""
    return -(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))


def safe_ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """``a / b``, or ``empty`` where ``b`` is zero."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / F.nullif(b, F.lit(0)))


def running_sum(numbers: Column, piece: int = 256) -> Column:
    """Running sums of an array of doubles, gathered in pieces so that no long array is copied for each element."""
    zero = F.struct(
        F.lit(0.0).alias("sum"),
        F.expr("CAST(array() AS array<double>)").alias("piece"),
        F.expr("CAST(array() AS array<array<double>>)").alias("done"),
    )

    def add(acc: Column, x: Column) -> Column:
        full, total = F.size(acc["piece"]) >= piece, acc["sum"] + x
        return F.struct(
            total.alias("sum"),
            F.when(full, F.array(total)).otherwise(F.array_append(acc["piece"], total)).alias("piece"),
            F.when(full, F.array_append(acc["done"], acc["piece"])).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(numbers, zero, add, lambda acc: F.flatten(F.array_append(acc["done"], acc["piece"])))
