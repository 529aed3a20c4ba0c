"""Whitening of integer vectors by shifted Cholesky QR.

The fit list holds every distinct vector once. Its centred rows are orthogonalised in passes over the data: tasks
solve their rows against the triangular factors found so far and add up the Gram matrix of what comes out; its Cholesky
factor, shifted by little where rounding or a lack of rank asks for it, is the next one. The product R of all factors
is that of a QR decomposition, so that the singular values and right vectors of this small matrix are those of the centred
rows, without the loss of half the digits that an eigenvalue decomposition of the covariance itself has.

The driver and the tasks hold matrices of the vectors' dimension only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .codes import as_matrix, integer_rows, smallest
from .common import stored

SCALE = 256
COMPONENTS = 4
#: Passes over the data at most; how near to orthonormal rows may stay; rows that a task solves at a time.
PASSES = 6
CLOSE = 1e-13
BLOCK_ROWS = 8192
#: A component whose deviation is below this share of the largest has no direction of its own.
FLAT = 1e-9

WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _added(partial: DataFrame, width: int) -> np.ndarray:
    """The sum of the rows that tasks bring for each ``place``, as a matrix; ``width`` rows reach the driver."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = as_matrix(batch.column(1), "<f8").sum(axis=0)
            total = rows if total is None else total + rows
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["place", "row"])

    found = partial.groupBy("place").applyInArrow(run, "place int, row binary").collect()
    out = np.zeros((width, width))
    for place, row in found:
        out[place] = np.frombuffer(row, "<f8")
    return out


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, np.int64)
        for batch in batches:
            n += batch.num_rows
            if batch.num_rows:
                total += as_matrix(batch.column(0)).sum(axis=0, dtype=np.int64)
        yield pa.record_batch([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array([*total.tolist(), n])], ["place", "total"])

    partial = fit.select("ints").mapInArrow(run, "place int, total bigint")
    found = dict(partial.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect())
    return int(found.get(dim, 0)), [int(found.get(k, 0)) for k in range(dim)]


def centred(ints: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n, the whole part of the mean taken off in integers."""
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([(s % n) / n for s in total])
    return (ints - whole).astype(np.float64) - rest


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The rows Q of Q R = rows for an upper triangular R."""
    out = np.empty_like(rows)
    for j in range(factor.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _gram(fit: DataFrame, dim: int, width: int, of_rows) -> np.ndarray:
    """The Gram matrix of ``of_rows`` of all vectors, added up by its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = of_rows(as_matrix(batch.column(0).slice(at, BLOCK_ROWS)))
                total += block.T @ block
        rows = pa.array([row.tobytes() for row in total], pa.binary())
        yield pa.record_batch([pa.array(np.arange(width, dtype=np.int32)), rows], ["place", "row"])

    return _added(fit.select("ints").mapInArrow(run, "place int, row binary"), width)


def cholesky(gram: np.ndarray) -> np.ndarray:
    """Upper triangular R with R'R = gram + s I for as small a shift s as rounding allows."""
    dim = len(gram)
    gram = (gram + gram.T) / 2
    shift = 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(dim)).T
        except np.linalg.LinAlgError:
            shift = 100 * shift or 11 * dim * (dim + 1) * np.finfo(float).eps * max(np.trace(gram), np.finfo(float).tiny)


def triangular_factor(fit: DataFrame, dim: int, n: int, total: list[int], passes: int = PASSES) -> np.ndarray:
    """R of the QR decomposition of the centred rows."""
    factors: list[np.ndarray] = []

    def orthogonal(ints: np.ndarray) -> np.ndarray:
        rows = centred(ints, n, total)
        for factor in factors:
            rows = solved(rows, factor)
        return rows

    whole = np.eye(dim)
    for _ in range(passes):
        gram = _gram(fit, dim, dim, orthogonal)
        if not np.trace(gram) > 0:
            return np.zeros((dim, dim)) if not factors else whole
        if factors and np.abs(gram - np.eye(dim)).max() <= CLOSE * dim:
            break
        factors.append(cholesky(gram))
        whole = factors[-1] @ whole
    return whole


def components(factor: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors of the covariance as rows, their eigenvalues, and these as shares of the trace.

    Directions without variance are no components. The sign makes a component's entry of largest magnitude positive.
    """
    _, scale, right = np.linalg.svd(factor)
    kept = min(count, int((scale > FLAT * scale[0]).sum()) if len(scale) and scale[0] > 0 else 0)
    right = right[:kept]
    heads = np.take_along_axis(right, np.abs(right).argmax(axis=1)[:, None], axis=1) if kept else np.ones((0, 1))
    return right * np.sign(heads), scale[:kept] ** 2 / n, scale[:kept] ** 2 / (scale ** 2).sum() if kept else scale[:0]


def deviations(ints: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 by row; NULL where a long does not hold it."""
    top = n * int(np.abs(ints).max(initial=0)) + max(map(abs, total), default=0)
    if top ** 2 * ints.shape[1] < 1 << 63:
        gap = n * ints.astype(np.int64) - np.array(total, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    gap = n * ints.astype(object) - np.array(total, object)
    return [int(v) if v < 1 << 63 else None for v in (gap * gap).sum(axis=1)]


def whiten(table: DataFrame, count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Every usable row by component, numbered from 1 by falling eigenvalue (``WHITENED``).

    Rows whose vector is NULL, empty, or holds a NULL or non-finite component are dropped, as are vectors of another
    length than that of the smallest kept id. Rows that repeat an id or have none are whitened like others, and a vector
    that many rows hold counts once in the fit. Fewer components than asked for come where vectors vary in fewer directions,
    and no rows where they do not vary at all. ``deviation`` is NULL where a long does not hold it. Other columns are
    not read; a table without usable rows gives none.
    """
    empty = table.sparkSession.createDataFrame([], WHITENED)
    rows = stored(integer_rows(table, scale).drop("label"), "vectors")
    first = smallest(rows, 1)
    if not first:
        return empty
    dim = first[0]["dim"]
    rows = rows.filter(F.col("dim") == dim)
    fit = stored(rows.select("ints").distinct(), "fit")
    n, total = sums(fit, dim)
    directions, variance, share = components(triangular_factor(fit, dim, n, total), n, count)
    kept = len(variance)
    if not kept:
        return empty
    projection = (directions / np.sqrt(variance)[:, None]).T

    def with_one(ints: np.ndarray) -> np.ndarray:  # its Gram matrix holds products and sums
        return np.column_stack([centred(ints, n, total) @ projection, np.ones(len(ints))])

    gram = _gram(fit, dim, kept + 1, with_one) / n
    covariance = gram[:kept, :kept] - np.outer(gram[kept, :kept], gram[kept, :kept])
    identity_error = float(np.abs(covariance - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ints, size = as_matrix(part.column(1)), part.num_rows
                each = np.repeat(np.arange(size), kept)
                yield pa.record_batch([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * kept, n)), pa.array(deviations(ints, n, total), pa.int64()).take(pa.array(each)),
                    pa.array((centred(ints, n, total) @ projection).ravel()), pa.array(np.tile(share, size)),
                    pa.array(np.full(size * kept, identity_error)),
                ], [f.split()[0] for f in WHITENED.split(", ")])

    return rows.select("vec_id", "ints").mapInArrow(run, WHITENED)
