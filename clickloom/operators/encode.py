"""Label codes, scaling, one-hot columns, the hashing trick and sparse-row transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions import scalar as fn
from clickloom.operators.lookup import DEFAULT_LIMITS, JoinLimits, lookup_join, row_bytes, within_total
from clickloom.operators.ordinal import running_totals
from clickloom.session import materialize

# Fixed value: default size of a hashed weight table.
HASH_SIZE = 2**20


# A value sits in the one field its type belongs to, and sorts by it.
_TYPED = {
    "number": "double", "whole": "bigint", "exact": "decimal(38,18)", "day": "date", "time": "timestamp",
    "local": "timestamp_ntz", "flag": "boolean", "text": "string",
}
_FIELDS: list[tuple[tuple[type[T.DataType], ...], str]] = [
    ((T.StringType,), "text"),
    ((T.FloatType, T.DoubleType), "number"),
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "whole"),
    ((T.DecimalType,), "exact"),
    ((T.DateType,), "day"),
    ((T.TimestampType,), "time"),
    ((T.TimestampNTZType,), "local"),
    ((T.BooleanType,), "flag"),
]


def _field(dtype: T.DataType) -> str:
    for kinds, field in _FIELDS:
        if isinstance(dtype, kinds):
            return field
    raise TypeError(f"values of type {dtype.simpleString()} have no codes")


def label_codes(df: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """``(column, a field per type, n, code)``: a value's rank among its column's sorted values.

    Numbers rank as numbers, text by its bytes. All columns take one scan and one shuffle.
    """

    def entry(c: str) -> Column:
        used = _field(df.schema[c].dataType)
        parts = [(F.col(c) if f == used else F.lit(None)).cast(t).alias(f) for f, t in _TYPED.items()]
        return F.struct(F.lit(c).alias("column"), *parts)

    entries = df.select(F.explode_outer(F.array(*[entry(c) for c in columns])).alias("e")).select("e.*")
    held = entries.where(F.coalesce(*[F.col(f).cast("string") for f in _TYPED]).isNotNull())
    values = materialize(held.groupBy("column", *_TYPED).agg(F.count("*").alias("n")), "values")
    one = {"code": F.lit(1).cast("bigint")}
    ranked = running_totals(values, list(_TYPED), one, ("column",), buckets=buckets)
    return ranked.withColumn("code", F.col("code") - 1)


def fit_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """The code table of ``label_codes``, written out, one folder per column."""
    return materialize(label_codes(df, columns), "codes", ("column",))


def apply_codes(
    df: DataFrame, codes: DataFrame, columns: list[str], limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Replace values by their codes; an unknown value becomes null."""
    per_column = codes.groupBy("column").agg(F.sum(row_bytes(codes)).alias("b"))
    sizes = within_total({r["column"]: r["b"] for r in per_column.collect()}, limits)
    out = df
    for c in columns:
        dtype = df.schema[c].dataType
        value = F.col(_field(dtype)).cast(dtype).alias(c)
        one = codes.where(F.col("column") == c).select(value, F.col("n").alias("_n"), F.col("code").alias(f"_code_{c}"))
        out = lookup_join(out, one, [c], "left", weight="_n", limits=limits, known_bytes=sizes.get(c, 0)).drop("_n")
    return out.select(*[F.col(f"_code_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def label_encode(df: DataFrame, columns: list[str], limits: JoinLimits = DEFAULT_LIMITS) -> DataFrame:
    """Replace values by their codes over the whole frame (train and test together)."""
    return apply_codes(df, fit_codes(df, columns), columns, limits)


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, from one pass."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 0.0) for c in columns}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Centre and scale; a column without spread becomes 0."""

    def scaled(c: str, mean: float, std: float) -> Column:
        centred = F.col(c).cast("double") - F.lit(float(mean))
        return centred / F.lit(float(std)) if std > 0 else centred * 0.0

    return df.withColumns({c: scaled(c, m, s) for c, (m, s) in scaler.items()})


def one_hot(df: DataFrame, column: str, classes: list[int]) -> DataFrame:
    return df.withColumns({f"{column}_{k}": (F.col(column) == k).cast("int") for k in classes})


def hash_tokens(columns: list[str], size: int = HASH_SIZE) -> list[Column]:
    """One weight slot per column, from ``column_value``; nulls hash like ''."""
    return [fn.token_index(c, F.coalesce(F.col(c).cast("string"), F.lit("")), size) for c in columns]


def hash_features(df: DataFrame, columns: list[str], size: int = HASH_SIZE, name: str = "x") -> DataFrame:
    """Hashed slots of a row as an array with the bias slot 0 first."""
    return df.withColumn(name, F.array(F.lit(0).cast("bigint"), *hash_tokens(columns, size)))


def slot_pairs(ordered: str, n: int) -> list[tuple[Column, Column]]:
    """Every pair of the ``n`` sorted slots of one row, smaller slot first."""
    return [(F.col(ordered)[i], F.col(ordered)[j]) for i in range(n) for j in range(i + 1, n)]


def with_sorted_slots(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Hash each column once, then sort: ``_slots`` and ``_ordered``."""
    slots = df.withColumn("_slots", F.array(*hash_tokens(columns, size)))
    return slots.withColumn("_ordered", F.sort_array("_slots"))


def hash_interactions(df: DataFrame, columns: list[str], size: int = HASH_SIZE, name: str = "x") -> DataFrame:
    """Bias slot, hashed columns and a hashed slot for every column pair."""
    slots = with_sorted_slots(df, columns, size)
    crossed = [F.pmod(fn.hash32(a, b), F.lit(size)) for a, b in slot_pairs("_ordered", len(columns))]
    whole = F.concat(F.array(F.lit(0).cast("bigint")), "_slots", F.array(*crossed))
    return slots.withColumn(name, whole).drop("_slots", "_ordered")


def pair_interactions(df: DataFrame, columns: list[str], row_key: str = "ID", size: int = HASH_SIZE) -> DataFrame:
    """The slot pairs of every row as ``(row key, left, right)``; the count is fixed by the columns."""
    slots = with_sorted_slots(df.select(row_key, *columns), columns, size)
    pairs = [F.struct(a.alias("left"), b.alias("right")) for a, b in slot_pairs("_ordered", len(columns))]
    return slots.select(row_key, F.explode_outer(F.array(*pairs)).alias("p")).select(row_key, "p.left", "p.right")


def row_normalize(df: DataFrame, features: str = "features", mode: str = "squared") -> DataFrame:
    """Divide a row's values by their squared norm, or by the norm with ``mode="l2"``."""
    squares = fn.array_sum(F.transform(features, lambda f: f["value"] * f["value"]))
    norm = F.sqrt(squares) if mode == "l2" else squares
    with_norm = df.withColumn("_norm", F.when(norm > 0, norm).otherwise(F.lit(1.0)))
    scaled = F.transform(
        features, lambda f: F.struct(f["idx"].alias("idx"), (f["value"] / F.col("_norm")).alias("value"))
    )
    return with_norm.withColumn(features, scaled).drop("_norm")


def feature_dropout(
    df: DataFrame, dropout: float, row_key: str, features: str = "features", seed: int = 1024
) -> DataFrame:
    """Keep each entry with probability ``1 - dropout``, decided by row, index and seed."""
    kept = F.filter(features, lambda f: fn.unit_hash(F.col(row_key), f["idx"], seed=seed) >= dropout)
    return df.withColumn(features, kept)
