"""Reproducible samples, splits and folds.

A row's place depends on its key and the seed only, so it stays the same under any
partitioning, retry or growth of the table.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalar import hash32, unit_hash

SEED = 2017


def place(row_key: str = "ID", seed: int | str = SEED) -> Column:
    return unit_hash(F.col(row_key), seed=seed)


def sample(df: DataFrame, fraction: float, row_key: str = "ID", seed: int | str = SEED) -> DataFrame:
    return df.where(place(row_key, seed) < fraction)


def _first_rows(df: DataFrame, share: Callable[[int], int], row_key: str, seed: int | str) -> Column:
    """Condition that holds for exactly the ``share(rows)`` rows placed first.

    The last place that still counts is found by two histograms of fixed size, over the
    upper and then the lower half of the hash, so no row is sorted or moved; the first
    also counts the rows. Only rows that share that place, told apart by their key, may
    need a third look.
    """
    hashed = df.select(F.col(row_key).alias("k"), hash32(F.col(row_key), F.lit(str(seed))).alias("h"))
    upper = _bins(hashed.select(F.shiftright("h", 16).alias("b"), "k"))
    wanted = share(sum(n for _, n, _ in upper))
    if wanted <= 0:
        return F.lit(False)
    bin_, left, _, _ = _last_bin(upper, wanted)
    if bin_ is None:
        return F.lit(True)
    inside = hashed.where(F.shiftright("h", 16) == bin_)
    lower, left, size, key = _last_bin(_bins(inside.select(F.col("h").bitwiseAND(0xFFFF).alias("b"), "k")), left)
    last = bin_ * 65536 + lower
    if left < size:
        tied = inside.where(F.col("h") == last).orderBy("k").limit(left)
        key = tied.agg(F.max("k").alias("k")).first()["k"]
    h = hash32(F.col(row_key), F.lit(str(seed)))
    return (h < last) | ((h == last) & (F.col(row_key) <= key))


def _bins(rows: DataFrame) -> list[tuple[int, int, object]]:
    """Bin, rows and greatest key of each of at most 65,536 bins."""
    found = rows.groupBy("b").agg(F.count("*").alias("n"), F.max("k").alias("k")).orderBy("b")
    return [(r["b"], r["n"], r["k"]) for r in found.collect()]


def _last_bin(bins: list[tuple[int, int, object]], wanted: int) -> tuple[int | None, int, int, object]:
    """Bin that holds the ``wanted``-th row in bin order, how many it must give, its rows and greatest key."""
    for b, n, key in bins:
        if n >= wanted:
            return b, wanted, n, key
        wanted -= n
    return None, 0, 0, None


def sample_exact(df: DataFrame, fraction: float, row_key: str = "ID", seed: int | str = SEED) -> DataFrame:
    """Exactly ``round(fraction * rows)`` rows of a table with unique keys."""
    return df.where(_first_rows(df, lambda n: round(n * fraction), row_key, seed))


def mark_validation(df: DataFrame, share: float, row_key: str = "ID", seed: int | str = SEED) -> DataFrame:
    """Flag about ``share`` of the rows as validation."""
    return df.withColumn("is_valid", place(row_key, f"valid{seed}") < share)


def mark_validation_exact(df: DataFrame, share: float, row_key: str = "ID", seed: int | str = SEED) -> DataFrame:
    """Flag exactly ``ceil(share * rows)`` rows of a table with unique keys as validation."""
    first = _first_rows(df, lambda n: ceil(n * share), row_key, f"valid{seed}")
    return df.withColumn("is_valid", first)


def train_valid_split(
    df: DataFrame, share: float, row_key: str = "ID", seed: int | str = SEED
) -> tuple[DataFrame, DataFrame]:
    marked = mark_validation(df, share, row_key, seed)
    return (
        marked.where(~F.col("is_valid")).drop("is_valid"),
        marked.where("is_valid").drop("is_valid"),
    )


def add_fold(df: DataFrame, folds: int = 5, row_key: str = "ID", seed: int | str = SEED) -> DataFrame:
    fold = F.pmod(hash32(F.col(row_key), F.lit(f"fold{seed}")), F.lit(folds))
    return df.withColumn("fold", fold.cast("int"))
