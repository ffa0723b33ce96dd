"""Column helpers for arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums are gathered in pieces of this length, so that no long array is copied for each element.
_PIECE = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column) -> Column:
    """Running sums of an array of longs."""
    zero = F.struct(
        F.lit(0).cast("long").alias("sum"),
        F.expr("CAST(array() AS array<bigint>)").alias("piece"),
        F.expr("CAST(array() AS array<array<bigint>>)").alias("done"),
    )

    def add(acc: Column, x: Column) -> Column:
        full = F.size(acc["piece"]) >= _PIECE
        total = acc["sum"] + x
        return F.struct(
            total.alias("sum"),
            F.when(full, F.array(total)).otherwise(F.array_append(acc["piece"], total)).alias("piece"),
            F.when(full, F.array_append(acc["done"], acc["piece"])).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(numbers, zero, add, lambda acc: F.flatten(F.array_append(acc["done"], acc["piece"])))
