"""Shape, null and preview reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.ordinal import running_totals
from clickloom.operators.prep import is_missing


def shape(df: DataFrame, by: str | None = None) -> DataFrame:
    """Row and column counts, per value of ``by`` if given (which is not counted)."""
    width = len(df.columns) - (1 if by else 0)
    rows = df.groupBy(*([by] if by else [])).agg(F.count("*").alias("n_rows"))
    return rows.withColumn("n_cols", F.lit(width))


def null_fraction(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of missing values per column, in one pass."""
    columns = columns or df.columns
    shares = df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(c) for c in columns])
    return shares.unpivot([], columns, "column", "null_fraction")


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def running_mean_loss(df: DataFrame, loss: Column, order_by: list[str], every: int) -> DataFrame:
    """Mean loss of all earlier rows at every ``every``-th row; 0 before the first."""
    measured = df.select(*order_by, loss.alias("_loss"))
    totals = running_totals(measured, order_by, {"_n": F.lit(1).cast("bigint"), "_sum": F.col("_loss")})
    seen = F.col("_n") - 1
    mean = F.when(seen == 0, F.lit(0.0)).otherwise((F.col("_sum") - F.col("_loss")) / F.nullif(seen, F.lit(0)))
    return totals.where(seen % every == 0).select(seen.alias("t"), mean.alias("mean_loss"))
