"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

IMPRESSIONS = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("siteid", T.DoubleType()),
        T.StructField("offerid", T.LongType()),
        T.StructField("category", T.IntegerType()),
        T.StructField("merchant", T.IntegerType()),
        T.StructField("countrycode", T.StringType()),
        T.StructField("browserid", T.StringType()),
        T.StructField("devid", T.StringType()),
        T.StructField("click", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)

PREDICTIONS = T.StructType(
    [T.StructField("ID", T.StringType()), T.StructField("click", T.DoubleType())]
)

METRIC_LOG = T.StructType(
    [T.StructField("iter", T.IntegerType()), T.StructField("AUC", T.DoubleType())]
)

TIME_LOG = T.StructType(
    [
        T.StructField("iter", T.IntegerType()),
        T.StructField("remaining_ms", T.LongType()),
        T.StructField("elapsed_ms", T.LongType()),
    ]
)

FM_WEIGHTS = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("w", T.DoubleType()),
        T.StructField("v", T.ArrayType(T.DoubleType())),
    ]
)

KEY_VALUE = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
)

# Columns that are never model inputs.
NOT_FEATURES = ("ID", "datetime", "click", "split")


def all_doubles(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])

# The columns that are categories, by name.
CATEGORIES = ("siteid", "offerid", "category", "merchant", "countrycode", "browserid", "devid")
