"""Helpers for vectors as whole numbers, packed as 8 bytes a component."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import arrow

# Bytes of vectors that one step holds as doubles.
STEP_BYTES = 8 << 20


def whole(rows: DataFrame, vector: str, factor: float, keep: dict[str, str], shift: int = 0) -> DataFrame:
    """The columns of ``keep`` (new name: old name) and ``x``, the components as floor(factor * component) + shift.

    Rows whose vector is null, empty, or holds a null or a number that is not finite are left out. Components beyond
    sqrt(2^62 / length) count as that number, so that any inner product fits a long.
    """
    chosen = rows.select(*[F.col(old).alias(new) for new, old in keep.items()], F.col(vector).cast("array<double>").alias("x"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(lambda batches: _pack(batches, factor, shift), f"{fields}, x binary")


def _pack(batches: Iterable[pa.RecordBatch], factor: float, shift: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(batch.num_columns - 1)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
        good = (sizes > 0) & (arrow.sums(~np.isfinite(flat), offsets) == 0)
        limit = np.array([isqrt((1 << 62) // max(1, d)) for d in sizes.tolist()], np.float64)
        limit = np.repeat(limit, sizes)
        values = np.where(np.isfinite(flat), np.clip(np.floor(flat * factor), -limit, limit), 0).astype("<i8") + shift
        packed = pa.Array.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets * 8), pa.py_buffer(values)]
        ).cast(pa.binary())
        kept = pa.array(good)
        columns = [batch.column(i).filter(kept) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, packed.filter(kept)], batch.schema.names)


def usual_length(packed: DataFrame) -> int:
    """The number of components that most rows have, the greater of equally frequent ones; 0 without rows."""
    sizes = packed.groupBy(F.octet_length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes"))
    first = sizes.first()
    return first["bytes"] // 8 if first else 0


def blocks(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors, as many rows as ``STEP_BYTES`` hold."""
    most = max(1, STEP_BYTES // (8 * max(1, length)))
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            yield part, unpack(arrow.column(part, "x"), length)


def unpack(column: pa.Array, length: int) -> np.ndarray:
    """Packed vectors of one length as a matrix of longs."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros((0, length), np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view("<i8").reshape(len(column), length)
