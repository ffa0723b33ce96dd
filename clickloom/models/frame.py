"""The feature table models are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from math import ceil
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from clickloom.operators import counts, encode, prep

# Rows of a part of a training table. A learner keeps more beside a row than the row itself: a forest a number for each tree.
PART_ROWS = 200_000

Item, Result = TypeVar("Item"), TypeVar("Result")


def model_frame(
    imps: DataFrame,
    n_counts: int = 6,
    fill: dict[str, float | str] = prep.FILL_NONE,
    null_keys: str = "keep",
    unique_key: bool = False,
) -> DataFrame:
    """Impute, time parts, pair counts and label codes; train and test together.

    Null keys are kept by default so that every test row gets a prediction. ``unique_key`` declares that no ID is repeated.
    """
    df = prep.prepare(imps, fill)
    names = counts.FEATURE_SETS[n_counts] if n_counts else []
    text = prep.columns_of_type(df, T.StringType, exclude=("ID", "split"))
    # The same rows as after counting, without computing the counts for it.
    kept = df.na.drop(subset=counts.key_columns(names)) if names and null_keys == "drop" else df
    codes = encode.fit_codes(kept, text)
    counted = counts.add_pair_counts(df, names, null_keys=null_keys, unique_key=unique_key) if names else df
    return encode.apply_codes(counted, codes, text)


def assemble(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    """Feature vector; what is still missing becomes -1, apart from every code and count."""
    filled = df.fillna(-1, subset=features)
    return VectorAssembler(inputCols=features, outputCol=name).transform(filled)


def click_probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def train_part(df: DataFrame) -> DataFrame:
    return df.where("split = 'train'").withColumn("label", F.col("click").cast("double"))


def test_part(df: DataFrame) -> DataFrame:
    return df.where("split = 'test'")


def dealt(df: DataFrame, part_rows: int = PART_ROWS, row_key: str = "ID") -> DataFrame:
    """The rows in parts of about ``part_rows``, so that parts grow in number and not in size; a table with enough of them as it is.

    Files are read in few large parts. Rows are in order of their key, so that samples a learner draws from a part come out again.
    """
    if row_key not in df.columns:
        return df
    parts = ceil(df.count() / part_rows)
    if parts <= df.rdd.getNumPartitions():
        return df
    return df.repartition(parts, row_key).sortWithinPartitions(row_key)


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a training table for the passes of one fit, in parts of bounded rows; spills, and lost blocks recompute."""
    df = dealt(df)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def side_by_side(spark: SparkSession, run: Callable[[Item], Result], items: Iterable[Item], most: int = 2) -> list[Result]:
    """Results of ``run`` in the order of the items. Up to ``most`` run at once: one fills the cores the last tasks of another leave idle."""
    with ThreadPool(most) as pool:
        return pool.map(inheritable_thread_target(spark)(run), items, chunksize=1)
