"""Whitening of embeddings by the singular values of their centred rows.

Blocks of centred rows are reduced by QR in the tasks, their triangles are reduced again in groups of ``FAN`` until one is
left, and that triangle, no larger than the square of the vector length, is solved by ``bidiagonal``. Nothing else comes
to the driver than sums per dimension and the covariance of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import bidiagonal, vectors
from clickloom.session import materialize

# Components become floor(64 c) + 1,000,000.
FACTOR = 64.0
SHIFT = 1_000_000
COMPONENTS = 16
FAN = 16
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: rows, sums per dimension, components as columns, their eigenvalues, the trace, the check."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def length(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, with one rounding: the whole part of the mean is taken off as a whole number."""
        mean, rest = self._means()
        return (x - mean) - rest / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 per row, exact; None where it exceeds a long."""
        mean, rest = self._means()
        apart = x - mean
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if self.length * most * most <= LONG:
            return ((self.n * apart - rest) ** 2).sum(1).tolist()
        exact = self.n * apart.astype(object) - rest.astype(object)
        return [v if v <= LONG else None for v in (exact * exact).sum(1).tolist()]

    def _means(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)


def fit(packed: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors of ``packed`` (column ``x``); None without vectors.

    The fit list holds the vectors of the length that most distinct vectors have. Components number at most ``most`` and
    the directions in which the list varies at all.
    """
    distinct = materialize(packed.select("x").distinct(), "fit_list")
    length = vectors.usual_length(distinct)
    if not length:
        return None
    listed = distinct.where(F.octet_length("x") == 8 * length)
    sums = listed.mapInArrow(lambda batches: _sums(batches, length), "dim int, n long, total decimal(38,0)")
    rows = sums.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    bare = Whitening(int(rows[0]["n"]), tuple(int(r["total"]) for r in rows), np.zeros((length, 0)), np.zeros(0), 0.0)
    triangle = _triangle(listed, bare)
    squares, components = bidiagonal.right_vectors(triangle, most)
    trace = float((triangle * triangle).sum()) / bare.n
    model = Whitening(bare.n, bare.sums, components, squares / bare.n, trace)
    return Whitening(model.n, model.sums, components, model.values, trace, _identity_error(listed, model))


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: one row for each of ``rows`` (id, x) and component."""
    fields = f"{rows.select('id').schema.fields[0].dataType.simpleString()}"
    schema = f"id {fields}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    fitting = rows.select("id", "x").where(F.octet_length("x") == 8 * model.length)
    return fitting.mapInArrow(lambda batches: _whitened(batches, model), schema)


def whiten_table(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Whitened rows of a table of embeddings, as ``whiten`` gives them, with the name of its id column.

    Rows whose vector is null or empty, or holds a null or a number that is not finite, are left out, as are rows of
    another length than most distinct vectors have (the longer one of equally frequent lengths). Repeated rows come
    repeatedly but count once in the fit, whatever their ids; a null id stays null; other columns are ignored. Directions
    without variance have no component, so a table of equal vectors, or an empty one, gives no rows.
    """
    packed = vectors.whole(table, vector_col, FACTOR, {"id": id_col}, SHIFT)
    return whiten(packed, fit(packed, most)).withColumnRenamed("id", id_col)


def _sums(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    totals, n = [0] * length, 0
    for part, x in vectors.blocks(batches, length):
        n += part.num_rows
        # Halves of 32 bits, so that no sum of a block overflows.
        low, high = (x & 0xFFFFFFFF).sum(0).tolist(), (x >> 32).sum(0).tolist()
        totals = [t + a + (b << 32) for t, a, b in zip(totals, low, high)]
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()), pa.array(totals, pa.decimal128(38, 0))],
            ["dim", "n", "total"],
        )


def _triangle(listed: DataFrame, bare: Whitening) -> np.ndarray:
    """R of the QR decomposition of all centred rows; missing rows are zero."""
    parts = materialize(listed.mapInArrow(lambda batches: _reduce(batches, bare), "no int, r binary"), "triangles")
    last = parts.agg(F.max("no")).first()[0]
    while last > 0:
        groups = parts.withColumn("no", F.floor(F.col("no") / FAN).cast("int")).groupBy("no")
        parts = materialize(groups.applyInArrow(lambda key, table: _stacked(key, table, bare.length), "no int, r binary"), "triangles")
        last //= FAN
    r = np.frombuffer(parts.first()["r"]).reshape(-1, bare.length)
    return np.vstack([r, np.zeros((bare.length - len(r), bare.length))])


def _reduce(batches: Iterable[pa.RecordBatch], bare: Whitening) -> Iterator[pa.RecordBatch]:
    r = None
    for _, x in vectors.blocks(batches, bare.length):
        rows = bare.centred(x)
        r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
    if r is not None:
        yield _one(TaskContext.get().partitionId(), r)


def _stacked(key: tuple, table: pa.Table, length: int) -> pa.Table:
    # In an order that no shuffle changes.
    parts = sorted(table.column("r").to_pylist())
    r = np.linalg.qr(np.vstack([np.frombuffer(p).reshape(-1, length) for p in parts]), mode="r")
    return pa.Table.from_batches([_one(key[0].as_py(), r)])


def _one(no: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], ["no", "r"])


def _identity_error(listed: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    parts = listed.mapInArrow(lambda batches: _products(batches, model), "i int, j int, total double")
    entries = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    covariance, means = np.zeros((k, k)), np.zeros(k)
    for i, j, total in entries:
        if j < 0:
            means[i] = total / model.n
        else:
            covariance[i, j] = total / model.n
    # The rows are centred already; what their means still are is rounding.
    return float(np.abs(covariance - np.outer(means, means) - np.eye(k)).max())


def _products(batches: Iterable[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    total, n = np.zeros((k, k + 1)), 0
    for part, x in vectors.blocks(batches, model.length):
        n += part.num_rows
        w = model.project(x)
        total[:, :k] += w.T @ w
        total[:, k] += w.sum(0)
    if n:
        i, j = np.divmod(np.arange(k * (k + 1)), k + 1)
        j = np.where(j == k, -1, j)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "total"]
        )


def _whitened(batches: Iterable[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    explained = model.values / model.trace if k else np.zeros(0)
    for part, x in vectors.blocks(batches, model.length):
        m = part.num_rows
        each = np.repeat(np.arange(m), k)
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, model.n), pa.int64()),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(model.project(x).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, model.identity_error)),
            ],
            ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )
