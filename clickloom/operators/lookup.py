"""Join to a table with unique keys, safe against hot keys and large tables.

A table proven small is broadcast. Otherwise the few keys frequent enough to overload
a task are broadcast, their rows are spread by a salt, and the rest is a shuffle join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class JoinLimits:
    """Sizes that decide how a lookup runs.

    ``broadcast_total`` bounds all tables broadcast for one frame together.
    """

    broadcast_bytes: int = 64 * 1024 * 1024
    hot_rows: int = 1_000_000
    hot_share: float = 1e-4
    salts: int = 64
    broadcast_total: int = 256 * 1024 * 1024


DEFAULT_LIMITS = JoinLimits()


def row_bytes(df: DataFrame) -> Column:
    """Approximate in-memory bytes of a row: text and array lengths, 8 for the rest."""
    parts = [F.lit(16)]
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            parts.append(F.coalesce(F.octet_length(f.name), F.lit(0)) + 16)
        elif isinstance(f.dataType, T.ArrayType):
            parts.append(F.coalesce(F.size(f.name), F.lit(0)) * 16 + 16)
        else:
            parts.append(F.lit(8))
    size = parts[0]
    for p in parts[1:]:
        size = size + p
    return size


def within_total(sizes: dict, limits: JoinLimits) -> dict:
    """Sizes of several tables to look up in one frame, smallest first kept for broadcast.

    Those that would exceed the total get a size no broadcast allows.
    """
    spent, out = 0, {}
    for name, size in sorted(sizes.items(), key=lambda kv: kv[1]):
        fits = spent + size <= limits.broadcast_total
        spent += size if fits else 0
        out[name] = size if fits else limits.broadcast_bytes + 1
    return out


def table_bytes(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()["b"]


def _same(a: Column, b: Column, null_safe: bool) -> Column:
    return a.eqNullSafe(b) if null_safe else a == b


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "inner",
    null_safe: bool = False,
    weight: str | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
    known_bytes: int | None = None,
) -> DataFrame:
    """``df`` with the other columns of ``table``, whose ``keys`` are unique.

    ``weight`` names a column of ``table`` that counts the rows of ``df`` per key;
    without it the hot keys are counted in ``df``. The result never depends on the limits.
    """
    values = [c for c in table.columns if c not in keys]
    side = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *values, F.lit(True).alias("_hit"))
    match = [_same(F.col(k), F.col(f"_k_{k}"), null_safe) for k in keys]
    size = table_bytes(table) if known_bytes is None else known_bytes

    if size <= limits.broadcast_bytes:
        joined = df.join(F.broadcast(side), match, how)
        return joined.select(*df.columns, *values)

    hot = _hot_rows(df, side, keys, null_safe, weight, limits)
    hot = hot.select(
        *[F.col(f"_k_{k}").alias(f"_h_{k}") for k in keys],
        *[F.col(v).alias(f"_hv_{v}") for v in values],
        F.lit(True).alias("_hot"),
    )
    near = [_same(F.col(k), F.col(f"_h_{k}"), null_safe) for k in keys]
    # At most rows / hot threshold entries.
    rows = df.na.drop(subset=keys) if how == "inner" and not null_safe else df
    marked = rows.join(F.broadcast(hot), near, "left")
    # Rows that find nothing for lack of a key are spread as well.
    apart = F.coalesce(F.col("_hot"), F.lit(False))
    if not null_safe:
        apart = apart | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    salt = F.when(apart, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(limits.salts))).otherwise(F.lit(0))
    marked = marked.withColumn("_salt", salt.cast("int"))
    # Too large to be broadcast, whatever the size of its files. The salt is 0, computed: Spark drops a literal from the keys of the
    # join, and rows are then dealt by the other keys alone.
    none = F.pmod(F.xxhash64(*[F.col(f"_k_{k}") for k in keys]), F.lit(1)).cast("int")
    cold = side.withColumn("_k_salt", none).hint("merge")
    joined = marked.join(cold, [*match, F.col("_salt") == F.col("_k_salt")], "left")
    picked = [F.when(F.col("_hot"), F.col(f"_hv_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    if how == "inner":
        joined = joined.where(F.col("_hot") | F.col("_hit"))
    return joined.select(*df.columns, *picked)


def _hot_rows(
    df: DataFrame,
    side: DataFrame,
    keys: list[str],
    null_safe: bool,
    weight: str | None,
    limits: JoinLimits,
) -> DataFrame:
    """Rows of ``side`` whose key is frequent in ``df``; at most ``1 / hot_share`` of them."""
    if weight is not None:
        rows = side.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
        return side.where(F.col(weight) >= max(limits.hot_rows, int(rows * limits.hot_share), 1))
    rows = df.count()
    threshold = max(limits.hot_rows, int(rows * limits.hot_share), 1)
    frequent = df.groupBy(*keys).count().where(F.col("count") >= threshold).drop("count")
    frequent = frequent.select(*[F.col(k).alias(f"_f_{k}") for k in keys])
    match = [_same(F.col(f"_k_{k}"), F.col(f"_f_{k}"), null_safe) for k in keys]
    return side.join(F.broadcast(frequent), match, "left_semi")


def natural_join(left: DataFrame, right: DataFrame, weight: str | None = None) -> DataFrame:
    """Inner join on every shared column to a right side unique in those columns.

    Rows with a null in a shared column find no partner and are dropped.
    """
    shared = [c for c in left.columns if c in right.columns]
    return lookup_join(left, right, shared, "inner", weight=weight)
