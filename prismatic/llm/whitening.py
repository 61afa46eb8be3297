"""Embedding whitening by cyclic Jacobi rotations.

Tasks add up what the fit list has: first its sums, then the scatter of its centred vectors. Components are whole
numbers, so both are exact, and don't depend on how rows are dealt. The driver gets a number for each pair
of dimensions, whatever the number of rows, and turns the covariance by plane rotations, pair by pair
in rows, until nothing but the diagonal is left. Each rotation is judged against the two diagonal entries that it mixes, so
small eigenvalues come out as accurate as large ones. The matrix of the leading components, scaled, goes
to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES
from .repeats import discard, written

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Scaled components beyond it count as not finite: their squares don't fit a long any more.
LARGEST = float(1 << 40)
EPS = float(np.finfo(float).eps)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x, floor(scale * c) + shift of each component c; without vectors that are null, empty or hold a null, undefined, infinite or huge one."""
    x = F.col("vector")
    frame = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= F.lit(LARGEST / scale)))
    return frame.where(x.isNotNull() & (F.size(x) > 0) & fine).select("vec_id", F.transform(x, lambda v: F.floor(v * scale) + F.lit(shift).cast("long")).alias("x"))


def rows_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its x as a matrix of whole numbers."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def product(a: np.ndarray) -> np.ndarray:
    """The exact scatter of rows of whole numbers."""
    largest = int(np.abs(a).max(initial=0))
    if largest * largest * len(a) < 1 << 53:
        return (a.astype(float).T @ a.astype(float)).astype(np.int64).astype(object)
    return a.astype(object).T @ a.astype(object)


def summed(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and their sum in each dimension."""

    def work(batches):
        n, total = 0, np.zeros(width, object)
        for _, x in rows_of(batches, width):
            n += len(x)
            total = total + x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([Decimal(int(v)) for v in (n, *total)], pa.decimal128(38, 0))], ["i", "total"])

    found = {r["i"]: int(r["total"]) for r in fit.select("x").mapInArrow(work, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()}
    return found.get(-1, 0), [found.get(k, 0) for k in range(width)]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of the fit list, rounded once: vectors are centred to the whole part of their mean, and the rest of it is taken from the exact scatter."""
    width = len(sums)
    centre = np.array([s // n for s in sums], np.int64)
    rest = [s - n * (s // n) for s in sums]
    i, j = np.triu_indices(width)

    def work(batches):
        total = np.zeros((width, width), object)
        for _, x in rows_of(batches, width):
            total = total + product(x - centre)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "total"])

    scatter = fit.select("x").mapInArrow(work, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
    out = np.zeros((width, width))
    for a, b, total in scatter.collect():
        out[a, b] = out[b, a] = (n * int(total) - rest[a] * rest[b]) / (n * n)
    return out


def jacobi(v: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix; the largest entry of each vector is above 0."""
    a, u = v.copy(), np.eye(len(v))
    least = EPS * EPS * float(np.trace(v))
    for _ in range(sweeps):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                off, x, y = float(a[p, q]), float(a[p, p]), float(a[q, q])
                if abs(off) <= max(EPS * math.sqrt(abs(x * y)), least):
                    continue
                turned = True
                theta = (y - x) / (2 * off)
                t = math.copysign(1.0, theta) / (abs(theta) + math.hypot(theta, 1.0))
                c = 1 / math.hypot(t, 1.0)
                turn = np.array([[c, -t * c], [t * c, c]])
                a[[p, q]] = turn @ a[[p, q]]
                a[:, [p, q]] = a[:, [p, q]] @ turn.T
                a[p, q] = a[q, p] = 0.0
                u[:, [p, q]] = u[:, [p, q]] @ turn.T
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    values, u = values[order], u[:, order]
    return values, u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)


def identity_error(fit: DataFrame, n: int, sums: list[int], matrix: np.ndarray) -> float:
    """The largest entry by which the covariance of the whitened fit list differs from the identity, worked out from its vectors."""
    k = matrix.shape[1]
    i, j = (x.ravel().astype(np.int32) for x in np.indices((k + 1, k)))

    def work(batches):
        total = np.zeros((k + 1, k))
        for _, x in rows_of(batches, len(sums)):
            w = whiten(x, n, sums, matrix)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "total"])

    total = np.zeros((k + 1, k))
    for a, b, value in fit.select("x").mapInArrow(work, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect():
        total[a, b] = value / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(x: np.ndarray, n: int, sums: list[int], matrix: np.ndarray) -> np.ndarray:
    """x less its mean, by the matrix. The whole part of the mean is taken first, so nothing is lost to large means."""
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in sums])
    return ((x - centre).astype(float) - rest) @ matrix


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of (n * x - S) squared for each row; null where it doesn't fit a long."""
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([s - n * (s // n) for s in sums], np.int64)
    d = x - centre
    largest = n * (int(np.abs(d).max(initial=0)) + 1)
    if largest * largest * x.shape[1] < 1 << 63:
        return ((n * d - rest) ** 2).sum(axis=1).tolist()
    found = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in d]
    return [v if v < 1 << 63 else None for v in found]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of vectors and leading component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    The fit list holds each distinct vector once, n of them. Rows take no part whose vector is null, empty,
    or holds a null, undefined or infinite component (or one beyond 2**40 / scale), or has another
    length than most distinct vectors (the longer at a tie). Repeated rows and rows without id stay. A component whose
    eigenvalue is 0 but for rounding has no whitened form and is left out; so one distinct vector, or an
    empty table, gives no rows. deviation is null where it doesn't fit a long.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = whole_vectors(vectors, id_col, vector_col, scale, shift)
    fit = written(rows.groupBy("x").agg(F.size("x").alias("width")))
    common = fit.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    fit_list = fit.where(F.col("width") == width)
    n, sums = summed(fit_list, width) if width else (0, [])
    matrix, explained, error = np.zeros((width, 0)), [], 0.0
    if n > 1:
        v = covariance(fit_list, n, sums)
        values, u = jacobi(v)
        real = values > width * EPS * max(float(values[0]), 0.0)
        k = min(components, int(real.sum()))
        matrix, explained = u[:, :k] / np.sqrt(values[:k]), (values[:k] / math.fsum(np.diag(v))).tolist() if k else []
        error = identity_error(fit_list, n, sums, matrix) if k else 0.0
    discard(fit)
    k = matrix.shape[1]
    if not k:
        return spark.createDataFrame([], SCHEMA)

    def work(batches):
        for batch, x in rows_of(batches, width):
            ids, deviation = batch.column("vec_id"), pa.array(deviations(x, n, sums), pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), k))
            constant = [pa.array(np.full(len(x) * k, n, np.int64)), pa.array(np.full(len(x) * k, error))]
            component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            out = [ids.take(each), pa.array(component), constant[0], deviation.take(each), pa.array(whiten(x, n, sums, matrix).ravel()), pa.array(np.tile(explained, len(x))), constant[1]]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == width).mapInArrow(work, SCHEMA)
