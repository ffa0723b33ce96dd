"""Scans: impression CSVs, sparse text, predictions, numeric tables and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.sources import schema as S

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def read_impressions(spark: SparkSession, path: str, schema: T.StructType = S.IMPRESSIONS) -> DataFrame:
    """Headered CSV of impressions with an explicit schema, so nothing is read twice."""
    return spark.read.schema(schema).option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(path, header=True)


def read_train_test(spark: SparkSession, train_path: str, test_path: str) -> DataFrame:
    """The two files as one table; ``split`` tells them apart, test has no label."""
    fields = [f for f in S.IMPRESSIONS.fields if f.name != "split"]
    train = read_impressions(spark, train_path, T.StructType(fields))
    test_fields = T.StructType([f for f in fields if f.name != "click"])
    test = read_impressions(spark, test_path, test_fields)
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")), allowMissingColumns=True
    )


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV with every column kept as text and empty fields as ''."""
    return spark.read.csv(path, header=True, inferSchema=False).fillna("")


def parse_sparse(line: Column) -> tuple[Column, Column]:
    """Label and features of a ``y idx:value idx:value`` line; indices may start at 0.

    What cannot be read is null.
    """
    parts = F.split(F.trim(line), " ")
    pairs = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p != "")
    features = F.transform(
        pairs,
        lambda p: F.struct(
            F.get(F.split(p, ":"), F.lit(0)).try_cast("int").alias("idx"),
            F.get(F.split(p, ":"), F.lit(1)).try_cast("double").alias("value"),
        ),
    )
    return parts[0].try_cast("double"), features


def read_sparse_text(spark: SparkSession, path: str) -> DataFrame:
    """Sparse text rows as ``(y double, features array<struct<idx,value>>)``; malformed lines are left out."""
    lines = _sparse_lines(spark, path)
    return lines.where(~_malformed()).drop("line")


def read_malformed_sparse_text(spark: SparkSession, path: str) -> DataFrame:
    """The lines ``read_sparse_text`` leaves out, as ``line``."""
    return _sparse_lines(spark, path).where(_malformed()).select("line")


def _sparse_lines(spark: SparkSession, path: str) -> DataFrame:
    y, features = parse_sparse(F.col("value"))
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("value").alias("line"), y.alias("y"), features.alias("features"))


def _malformed() -> Column:
    unread = F.exists("features", lambda f: f["idx"].isNull() | f["value"].isNull())
    return F.col("y").isNull() | unread


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PREDICTIONS).csv(path, header=True)


def read_numeric(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """Delimited table of doubles, one of whose columns is ``class``."""
    return spark.read.schema(S.all_doubles(names)).csv(path, header=True, sep=sep)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.FM_WEIGHTS).parquet(path)


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.METRIC_LOG).csv(path, header=True, sep="\t")


def read_time_log(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``iter, remaining, elapsed`` log."""
    return spark.read.schema(S.TIME_LOG).csv(path, header=False, sep="\t")


def read_run_meta(spark: SparkSession, path: str) -> DataFrame:
    """Headerless key/value file; further fields of a line are ignored."""
    return spark.read.schema(S.KEY_VALUE).csv(path, header=False, sep="\t")


def pivot_meta(meta: DataFrame, keys: list[str]) -> DataFrame:
    """Key/value rows as one wide row with a column per key."""
    return meta.groupBy().agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys]
    )
