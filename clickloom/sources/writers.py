"""Sinks: predictions, row-id files, feature maps, sparse text and per-model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.ordinal import global_ordinal


def submission_frame(df: DataFrame, score: str | Column, row_key: str = "ID") -> DataFrame:
    score = F.col(score) if isinstance(score, str) else score
    return df.select(F.col(row_key).alias("ID"), score.cast("double").alias("click"))


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "error") -> str:
    """Write one file per task; readers take the folder as the table."""
    df.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path, header=header, sep=sep)
    return path


def row_id_frame(df: DataFrame, target: str, order_by: list[str]) -> DataFrame:
    """``ID,target`` with a running id from 0 in the given order."""
    return global_ordinal(df, order_by, "ID").select("ID", F.col(target).alias("target"))


def feature_map(df: DataFrame, features: list[str]) -> DataFrame:
    """``idx, name, type`` of the features that hold any value; type is ``q``."""
    held = df.agg(*[F.count(c).alias(c) for c in features])
    rows = held.unpivot([], list(features), "name", "n")
    position = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("name"))
    return rows.where("n > 0").select(
        (position - 1).cast("int").alias("idx"), "name", F.lit("q").alias("type")
    )


def sparse_lines(df: DataFrame, label: str = "y", features: str = "features") -> DataFrame:
    """Text lines ``y idx:value ...`` from an array of ``(idx, value)`` structs."""
    pairs = F.transform(features, lambda f: F.concat_ws(":", f["idx"].cast("string"), f["value"].cast("string")))
    return df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(pairs, " ")).alias("value"))


def write_weights(weights: DataFrame, path: str) -> str:
    """Factorisation-machine weights ``(idx, w, v)`` as a table."""
    weights.select("idx", "w", "v").write.parquet(path)
    return path


def scored_path(base: str, run: str, metric: str, value: float) -> str:
    """Output folder named after the score it reached."""
    return f"{base}/{run}-{metric}-{value:.12g}"


def write_model_scores(scores: DataFrame, path: str) -> str:
    """Long ``(ID, model, click)`` scores, one folder per model."""
    scores.write.partitionBy("model").csv(path, header=True)
    return path
