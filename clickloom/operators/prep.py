"""Imputation, time parts, projections, casts and label handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators.ordinal import global_ordinal
from clickloom.sources.schema import NOT_FEATURES

# The two sets of fill values.
FILL_NONE = {"siteid": -999.0, "browserid": "None", "devid": "None"}
FILL_DESKTOP = {"siteid": -999.0, "browserid": "Desktop", "devid": "Mozilla Firefox"}


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN where the type has it."""
    missing = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        missing = missing | F.isnan(column)
    return missing


def impute(df: DataFrame, fill: dict[str, float | str] = FILL_NONE) -> DataFrame:
    return df.fillna(fill)


def parse_datetime(df: DataFrame, column: str = "datetime") -> DataFrame:
    """Text to timestamp without zone; unreadable text becomes null."""
    return df.withColumn(column, F.col(column).try_cast("timestamp_ntz"))


def add_time_parts(df: DataFrame, column: str = "datetime") -> DataFrame:
    """Weekday (Monday is 0), hour and minute."""
    return df.withColumns(
        {"tweekday": F.weekday(column), "thour": F.hour(column), "tminute": F.minute(column)}
    )


def prepare(df: DataFrame, fill: dict[str, float | str] = FILL_NONE) -> DataFrame:
    return add_time_parts(impute(df, fill))


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = NOT_FEATURES) -> list[str]:
    """Model inputs by exclusion, in sorted order so that assembly never depends on it."""
    return sorted(c for c in df.columns if c not in exclude)


def columns_except(df: DataFrame, other: list[str]) -> list[str]:
    """Column difference that keeps the order of ``df``."""
    return [c for c in df.columns if c not in set(other)]


def columns_of_type(df: DataFrame, dtype: type[T.DataType], exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, dtype) and f.name not in exclude]


def project_features(df: DataFrame, exclude: tuple[str, ...] = NOT_FEATURES) -> DataFrame:
    return df.select(*feature_columns(df, exclude))


def cast_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric codes as text categories; a fraction that is zero is left out."""

    def as_text(c: str) -> Column:
        if not isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            return F.col(c).cast("string")
        whole = F.col(c).try_cast("bigint")
        return F.when(whole.cast("double") == F.col(c), whole.cast("string")).otherwise(F.col(c).cast("string"))

    return df.withColumns({c: as_text(c) for c in columns})


def label_from_text(df: DataFrame, column: str = "click", name: str = "y") -> DataFrame:
    """1.0 where the text label is ``1``, else 0.0; 0.0 throughout if there is no label."""
    y = F.when(F.col(column) == "1", 1.0).otherwise(0.0) if column in df.columns else F.lit(0.0)
    return df.withColumn(name, y)


def label_pm1(label: Column) -> Column:
    return F.when(label == 0, F.lit(-1.0)).otherwise(label.cast("double"))


def missing_indicators(df: DataFrame, columns: list[str], fill: dict[str, float | str]) -> DataFrame:
    """A 0/1 flag per column for missing values, with the values themselves filled."""
    flags = {f"{c}_missing": is_missing(df, c).cast("int") for c in columns}
    return df.withColumns(flags).fillna({c: fill[c] for c in columns})


def mark_holdout(
    df: DataFrame,
    order_by: list[str],
    every: int | None = None,
    after: str | None = None,
    time_column: str = "datetime",
) -> DataFrame:
    """Flag rows after a date, or every ``every``-th row along ``order_by``, as holdout."""
    held = F.lit(False)
    if after is not None:
        held = held | (F.to_date(time_column) > F.to_date(F.lit(after)))
    if every is None:
        return df.withColumn("holdout", held.cast("int"))
    placed = global_ordinal(df, order_by, "_t")
    return placed.withColumn("holdout", (held | (F.col("_t") % every == 0)).cast("int")).drop("_t")


def split_hierarchy(df: DataFrame, column: str, separator: str = ">", levels: int = 3) -> DataFrame:
    """Parts of a hierarchical value as ``level1..n``, '' where it is shorter."""
    parts = F.split(F.col(column), f"\\Q{separator}\\E")
    return df.withColumns(
        {f"level{i + 1}": F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(levels)}
    )
