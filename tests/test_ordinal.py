from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickloom.operators import ordinal
from clickloom.operators.ordinal import global_ordinal, running_totals


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1000).select(
        (F.col("id") * 7919 % 1009).cast("double").alias("x"),
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"),
        (F.col("id") % 3).alias("g"),
        (F.col("id") % 11).alias("m"),
        F.timestamp_seconds(F.col("id") % 17).cast("timestamp_ntz").alias("at"),
    )


@pytest.mark.parametrize("order_by", [["x"], ["name"], ["at", "name"]])
@pytest.mark.parametrize("buckets", [1, 7, 16])
def test_equals_single_window(numbers, order_by, buckets):
    got = global_ordinal(numbers, order_by, buckets=buckets)
    want = numbers.withColumn("ordinal", F.row_number().over(Window.orderBy(*order_by)).cast("bigint") - 1)
    assert rows(got, "name", "ordinal") == rows(want, "name", "ordinal")


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_by_group(numbers, descending):
    got = running_totals(numbers, ["x"], {"s": F.col("m")}, ("g",), descending, buckets=9)
    order = F.desc("x") if descending else F.asc("x")
    over = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got, "name", "s") == rows(numbers.withColumn("s", F.sum("m").over(over)), "name", "s")


@pytest.mark.parametrize("copies", [1, 4])
def test_rows_of_a_bucket_stay_bounded(numbers, monkeypatch, copies):
    """More rows make more buckets, not larger ones; no number of buckets is the most."""
    monkeypatch.setattr(ordinal, "BUCKET_ROWS", 50)
    more = numbers.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    placed = ordinal.in_buckets(more, ["x", "name", "c"])
    sizes = [r["count"] for r in placed.groupBy("_bucket").count().collect()]
    assert sum(sizes) == 1000 * copies
    assert len(sizes) >= 16 * copies and max(sizes) <= 150


def test_many_buckets(numbers, monkeypatch):
    monkeypatch.setattr(ordinal, "BUCKET_ROWS", 10)
    got = global_ordinal(numbers, ["name"])
    want = numbers.withColumn("ordinal", F.row_number().over(Window.orderBy("name")).cast("bigint") - 1)
    assert rows(got, "name", "ordinal") == rows(want, "name", "ordinal")


def test_null_keys_come_first(spark):
    df = spark.createDataFrame([(None, 5), (2.0, 1), (1.0, 10)], "x double, m int")
    assert rows(running_totals(df, ["x"], {"s": F.col("m")}), "x", "s") == [(1.0, 15), (2.0, 16), (None, 5)]


def test_empty(spark):
    df = spark.createDataFrame([], "x double")
    assert global_ordinal(df, ["x"]).collect() == []


def test_same_under_any_partitioning(numbers):
    a = global_ordinal(numbers.repartition(3), ["x"], buckets=8)
    b = global_ordinal(numbers.repartition(11), ["x"], buckets=8)
    assert rows(a, "name", "ordinal") == rows(b, "name", "ordinal")
