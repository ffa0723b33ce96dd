"""Global running totals and row numbers without a one-task window.

Rows are dealt by range into buckets of bounded size, as many as the rows need. Each bucket is summed by its own window,
and the totals of the buckets before it are added afterwards.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import materialize

# About so many rows are one bucket, whatever the size of the table.
BUCKET_ROWS = 1 << 20


def in_buckets(df: DataFrame, order_by: list[str], by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``, ascending along ``(*by, *order_by)``, written out; without it if one bucket is enough.

    The table is derived once; counting and the sampling of the ranges read the written copy.
    """
    rows = materialize(df, "rows")
    buckets = buckets or max(1, -(-rows.count() // BUCKET_ROWS))
    if buckets == 1:
        return rows
    placed = rows.repartitionByRange(buckets, *by, *order_by).withColumn("_bucket", F.spark_partition_id())
    return materialize(placed, "buckets")


def running_totals(
    df: DataFrame,
    order_by: list[str],
    measures: dict[str, Column],
    by: tuple[str, ...] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add the inclusive running total of each measure along ``order_by``.

    ``order_by`` must be unique within ``by``; collapse ties first. A hot key is then
    one row, so every bucket holds about its share.
    """
    names = list(measures)
    staged = df.select("*", *[m.alias(f"_m_{n}") for n, m in measures.items()])
    placed = in_buckets(staged, order_by, by, buckets)
    single = "_bucket" not in placed.columns
    parts = [*by] if single else [*by, "_bucket"]
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_by]
    upto = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("*", *[F.sum(f"_m_{n}").over(upto).alias(f"_in_{n}") for n in names])
    if single:
        return inside.select(*df.columns, *[F.col(f"_in_{n}").alias(n) for n in names])

    # One row for each bucket and group: few enough to add up in order.
    sums = placed.groupBy(*parts).agg(*[F.sum(f"_m_{n}").alias(f"_m_{n}") for n in names])
    bucket = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_k_{c}") for c in parts]
    offsets = sums.select(*keys, *[F.sum(f"_m_{n}").over(before).alias(f"_off_{n}") for n in names])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in parts])
    totals = [(F.col(f"_in_{n}") + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(n) for n in names]
    return inside.join(offsets, same).select(*df.columns, *totals)


def global_ordinal(
    df: DataFrame,
    order_by: list[str],
    name: str = "ordinal",
    by: tuple[str, ...] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Number rows from 0 along a unique ``order_by``."""
    counted = running_totals(df, order_by, {name: F.lit(1).cast("bigint")}, by, buckets=buckets)
    return counted.withColumn(name, F.col(name) - 1)
