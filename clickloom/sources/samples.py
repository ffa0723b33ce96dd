"""The library's input shapes, derived by Spark from the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table; its schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a table with fewer splits than cores out to all cores.

    The sample tables are one split each; larger tables pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click log with train and test rows, from events, customers and parts."""
    e = spread(table(spark, sf_dir, "events"), "event_id")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    parts = p.count()
    site = F.get_json_object("props", "$.k").cast("int")
    browser = F.col("user_id") % 6
    device = ((F.col("event_id") * 104729) % 1013) % 4
    names = ["Firefox", "Chrome", "Safari", "Edge", "Opera"]
    by_browser = F.coalesce(*[F.when(browser == i, b) for i, b in enumerate(names)])
    by_device = F.coalesce(*[F.when(device == i, d) for i, d in enumerate(["Mobile", "Desktop", "Tablet"])])
    return (
        e.join(c, F.col("user_id") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(p, F.col("p_partkey") == (F.col("event_id") * 7919) % parts)
        .select(
            F.col("event_id").cast("string").alias("ID"),
            F.col("ts").alias("datetime"),
            F.when(site % 10 != 0, site.cast("double")).alias("siteid"),
            F.col("p_partkey").alias("offerid"),
            F.col("p_size").alias("category"),
            F.substring("p_brand", 7, 10).cast("int").alias("merchant"),
            F.col("n_name").alias("countrycode"),
            by_browser.alias("browserid"),
            by_device.alias("devid"),
            F.when(F.col("event_type") == "click", 1).otherwise(0).alias("click"),
            F.when(((F.col("event_id") * 1299709) % 997) % 5 == 0, "test").otherwise("train").alias("split"),
        )
    )


def with_scores(imps: DataFrame) -> DataFrame:
    """Two deterministic, heavily tied scores for the metric and blend operators."""
    a = ((F.col("category") * 7 + F.col("offerid")) % 101) / F.lit(100.0)
    b = ((F.col("merchant") * 13 + F.minute("datetime")) % 101) / F.lit(100.0)
    return imps.withColumn("score_a", a).withColumn("score_b", b)


def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, y, features)`` rows, features as ``(idx, value)`` structs from 0."""
    indexed = F.transform(
        "embedding", lambda v, i: F.struct(i.cast("int").alias("idx"), v.cast("double").alias("value"))
    )
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        "vec_id", F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"), indexed.alias("features")
    )


def fm_weights(sparse_long: DataFrame, factors: int = 4) -> DataFrame:
    """Weight table ``(idx, w, v)`` over every index that occurs."""
    v = F.array(*[F.round(F.sin(F.col("idx") * 5 + f), 6) for f in range(factors)])
    return sparse_long.select("idx").distinct().select(
        "idx", F.round(F.sin(F.col("idx") + 1), 6).alias("w"), v.alias("v")
    )


# Fixed value: first day of the event stream.
START = "2024-01-01"


def day_number(ts: str) -> Column:
    return F.datediff(F.to_date(F.col(ts)), F.to_date(F.lit(START)))


def metric_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric log per event type and one over all events: ``(run, iter, AUC)``.

    Iterations are the days of the event stream.
    """
    e = table(spark, sf_dir, "events")
    runs = e.select(
        F.explode_outer(F.array(F.lit("all"), F.col("event_type"))).alias("run"),
        day_number("ts").alias("iter"),
        "value",
    )
    return runs.groupBy("run", "iter").agg(F.round(F.avg("value") / 100, 6).alias("AUC"))


def time_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed milliseconds at each iteration, measured on the event clock."""
    e = table(spark, sf_dir, "events")
    first = F.lit(START).cast("timestamp_ntz")
    elapsed = F.expr("timestampdiff(MICROSECOND, start, last)")
    per_day = e.groupBy(day_number("ts").alias("iter")).agg(F.max("ts").alias("last"))
    return per_day.withColumn("start", first).select(
        "iter", F.floor(elapsed / 1000).cast("bigint").alias("elapsed_ms")
    )
