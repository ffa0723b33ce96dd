"""FTRL over a file stream: each micro-batch is one learning round.

The state after batch k is the table ``state/k``, made from ``state/k-1`` alone, so a
batch that is run again after a failure writes the same state. Once batch k is written, only
it and the state it was made from are kept; the losses go to a log of their own, ``log/batch=k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators import ftrl
from clickloom.session import delete, folders


def _state_path(folder: str, version: int) -> str:
    return f"{folder}/state/{version}"


def read_state(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """State after batch ``version``, one of the last two; empty before the first."""
    if version < 0:
        return ftrl.empty_state(spark)
    return spark.read.parquet(_state_path(folder, version)).select("idx", "z", "n")


def train_batch(batch: DataFrame, version: int, folder: str, p: ftrl.Ftrl) -> None:
    """Score, learn, write the next state and the losses of one micro-batch, and drop states no later run can need."""
    spark = batch.sparkSession
    state = read_state(spark, folder, version - 1)
    done = ftrl.update(state, ftrl.score(batch, state, p), p)
    done.write.mode("overwrite").parquet(_state_path(folder, version))
    written = spark.read.parquet(_state_path(folder, version))
    losses = written.agg(F.sum("rows").alias("rows"), F.sum("loss").alias("loss"))
    losses.write.mode("overwrite").parquet(f"{folder}/log/batch={version}")
    # The batch before is committed, or this one would not run; a run after a failure starts from its state.
    for name in folders(spark, f"{folder}/state"):
        if name.isdigit() and int(name) < version - 1:
            delete(spark, _state_path(folder, int(name)))


def start(rows: DataFrame, folder: str, p: ftrl.Ftrl = ftrl.Ftrl()) -> StreamingQuery:
    """Learn from a streaming ``(y, x)`` frame until its present files are done.

    ``folder`` keeps the states and the stream's checkpoint and must be shared.
    """
    return (
        rows.writeStream.foreachBatch(lambda batch, version: train_batch(batch, version, folder, p))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def stream_rows(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Files of a folder as a stream; without a limit, all that are new form one batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def progress(spark: SparkSession, folder: str, versions: int) -> DataFrame:
    """Mean loss of each of the first micro-batches before it was learnt."""
    sums = spark.read.parquet(f"{folder}/log").where(F.col("batch") < versions)
    return sums.select("batch", "rows", (F.col("loss") / F.nullif(F.col("rows"), F.lit(0))).alias("loss"))
