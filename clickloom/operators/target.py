"""Category values as click rates of earlier rows, in a hashed order of rows.

A row's rate for a value is that of the rows with this value that come before it, so its own label never enters, nor do later
ones. The order is cut into buckets: what comes before a row is the sum over earlier buckets, and the running sum inside its
own. A value that holds a third of all rows is so spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalar import hash32
from clickloom.operators.lookup import JoinLimits, lookup_join
from clickloom.session import materialize

BUCKET_ROWS = 200_000
WEIGHT = 10.0
# The table of all values and pairs of values grows with the rows. In the driver, where a table that is broadcast is built, it
# takes several times its size, and there is one for every other table: only a small one is broadcast.
LIMITS = JoinLimits(broadcast_bytes=8 << 20)

Combination = tuple[str, ...]


def combinations_of(columns: Sequence[str], most: int = 2) -> list[Combination]:
    """Each column alone, then each pair, and so on up to ``most`` columns."""
    return [c for n in range(1, most + 1) for c in combinations(columns, n)]


def rate_name(combination: Combination) -> str:
    return "rate_" + "_".join(combination)


def _entries(df: DataFrame, combos: list[Combination], kept: list[Column]) -> DataFrame:
    """A row for each row and combination, with its value; nulls are values of their own."""
    values = [F.to_json(F.struct(*[F.col(c) for c in combo])) for combo in combos]
    return df.select(*kept, F.posexplode(F.array(*values)).alias("combo", "value"))


def _rate(hits: Column, n: Column, overall: float, weight: float) -> Column:
    return (F.coalesce(hits, F.lit(0.0)) + weight * overall) / (F.coalesce(n, F.lit(0)) + weight)


def _widened(df: DataFrame, rates: DataFrame, combos: list[Combination], row_key: str) -> DataFrame:
    columns = [F.max(F.when(F.col("combo") == i, F.col("rate"))).alias(rate_name(c)) for i, c in enumerate(combos)]
    # A row for each row of the table. Spark takes it for as small as the table's files, and would build it in the driver.
    return df.join(rates.groupBy(row_key).agg(*columns).hint("merge"), row_key)


def ordered_rates(
    train: DataFrame, others: list[DataFrame], combos: list[Combination], label: str = "label", row_key: str = "ID",
    weight: float = WEIGHT, seed: str = "order", bucket_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, list[DataFrame]]:
    """The tables with a column ``rate_…`` per combination of categories.

    Train rows, whose keys are unique, get the rate of earlier rows; the other tables get the rate over all train rows. Rates
    are drawn towards the overall one by ``weight`` rows, which an unknown value gets alone.
    """
    rows, overall = train.agg(F.count("*"), F.avg(F.col(label).cast("double"))).first()
    overall = overall or 0.0
    buckets = max(1, ceil(rows / bucket_rows))
    place = hash32(F.col(row_key), F.lit(seed))
    kept = [
        F.col(row_key), F.col(label).cast("double").alias("hit"), place.alias("place"),
        F.shiftright(place * F.lit(buckets), 32).alias("bucket"),
    ]
    entries = _entries(train, combos, kept)
    per_bucket = entries.groupBy("combo", "value", "bucket").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    totals = materialize(per_bucket, "totals")

    inside = Window.partitionBy("combo", "value", "bucket").orderBy("place", row_key).rowsBetween(Window.unboundedPreceding, -1)
    here = entries.select("*", F.sum("hit").over(inside).alias("own_hits"), F.count("hit").over(inside).alias("own_n"))
    if buckets > 1:
        earlier = Window.partitionBy("combo", "value").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select("combo", "value", "bucket", F.sum("hits").over(earlier).alias("hits"), F.sum("n").over(earlier).alias("n"))
        # As large as there are pairs of values, however small its file.
        here = here.join(before.hint("merge"), ["combo", "value", "bucket"])
        hits = F.coalesce("own_hits", F.lit(0.0)) + F.coalesce("hits", F.lit(0.0))
        count = F.col("own_n") + F.coalesce("n", F.lit(0))
    else:
        hits, count = F.col("own_hits"), F.col("own_n")
    rates = here.select(row_key, "combo", _rate(hits, count, overall, weight).alias("rate"))
    widened = _widened(train, rates, combos, row_key)

    whole = materialize(totals.groupBy("combo", "value").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")), "totals")
    out = []
    for other in others:
        found = lookup_join(_entries(other, combos, [F.col(row_key)]), whole, ["combo", "value"], "left", limits=LIMITS)
        rates = found.select(row_key, "combo", _rate(F.col("hits"), F.col("n"), overall, weight).alias("rate"))
        out.append(_widened(other, rates, combos, row_key))
    return widened, out
