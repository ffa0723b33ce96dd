"""Queries that learn from a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import ftrl
from clickloom.plans.linear import PROGRESS_BATCHES, ftrl_rows, progress_sql
from clickloom.plans.registry import query, rounded
from clickloom.session import new_path
from clickloom.streaming import ftrl_stream


@query("ftrl_stream", progress_sql("0", "batch, CAST(count(*) AS BIGINT) AS rows, round(avg(loss), 6) AS loss"))
def ftrl_stream_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progressive loss per micro-batch, as the train rows arrive in time order.

    Files land in the source folder batch by batch; each run of the stream takes up what
    is new and goes on from its checkpoint.
    """
    rows = ftrl_rows(spark, sf_dir)
    staged = ftrl.in_batches(rows, ["datetime", "ID"], -(-rows.count() // PROGRESS_BATCHES)).drop("datetime")
    source, folder = new_path(spark, "stream"), new_path(spark, "ftrl-stream")
    for b in range(PROGRESS_BATCHES):
        arrived = staged.where(F.col("batch") == b).drop("batch")
        arrived.write.mode("append").parquet(source)
        stream = ftrl_stream.stream_rows(spark, source, arrived.schema)
        ftrl_stream.start(stream, folder).awaitTermination()
    return rounded(ftrl_stream.progress(spark, folder, PROGRESS_BATCHES), "loss")
