"""Whitening of vectors by shifted Cholesky QR.

The fit list, each distinct vector once, is a pinned table. Every pass over it is one
distributed job that returns a Gram matrix (``d * d`` numbers, whatever the number of rows):

1. count and exact sums, from which rows are centred before anything is multiplied;
2. the Gram matrix G of the centred rows A; a shift is added before the Cholesky factor R1 is
   taken, so it exists however badly conditioned A is;
3. the Gram matrix of the rows after a triangular solve with R1, whose factor is R2; and so on
   until the rows are orthonormal. The factors are never inverted, and every pass solves with
   all factors so far, one after the other.

The factors' product R has the singular values of A, so the singular value decomposition
of R (on the driver, d by d) gives variances and components without squaring A's condition.
Directions without variance stay at zero in every pass and are no components: a table of
rank r has r of them at most.

Rows whose vector is null or holds a null or non-finite entry are left out. Vectors of
different lengths are fitted apart. Repeated rows count once in the fit and are returned as
often as they stand in the table; null ids are ids like any other. Tied variances
may give any basis of their space. An empty table, and one with a single distinct vector,
gives no rows. ``deviation`` is null where it exceeds a long. Other columns are left out,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kredenz.runtime import pin

ROUNDOFF = np.finfo(np.float64).eps / 2
BLOCK_ROWS = 1 << 16  # rows that one product sums up at most; rounding grows with it, not with the table
PASSES = 8
LONG_MOST = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )


def floored(rows: DataFrame, column: str, scale: int) -> Column:
    """``floor(scale * c)`` of each entry, kept in the entries' own type, which holds it exactly."""
    kind = rows.schema[column].dataType.elementType
    kind = kind.simpleString() if kind.simpleString() in ("float", "double") else "double"
    return F.transform(column, lambda c: F.floor(c.cast("double") * scale).cast(kind))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``Q`` with ``Q @ factor == rows`` for an upper triangular factor, column by column."""
    out = np.empty_like(rows)
    for j in range(factor.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """Entries as whole numbers: long where they fit, else Python's, held at the ends of a long."""
    if np.abs(x).max(initial=0) < 2.0**62:
        return x.astype(np.int64)
    ends = (-LONG_MOST - 1, LONG_MOST)
    return np.array([[min(max(int(v), ends[0]), ends[1]) for v in row] for row in x.tolist()], object)


def count_and_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = whole(matrix(batch))
            if len(x) and x.dtype != object and len(x) * int(np.abs(x).max()) > LONG_MOST:
                x = x.astype(object)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(0).tolist())]
        if n:
            values = [Decimal(v) for v in (n, *total)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, d), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["j", "s"]
            )

    found = fit.mapInArrow(run, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").alias("s")).collect()
    sums = {r.j: int(r.s) for r in found}
    return sums.get(-1, 0), [sums.get(j, 0) for j in range(d)]


def gram(fit: DataFrame, mapped: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """``M.T @ M`` of all rows after ``mapped``; each task sends one triangle of numbers."""
    upper = np.triu_indices(d)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                m = mapped(matrix(batch.slice(begin, BLOCK_ROWS)))
                total += m.T @ m
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(upper[0])), pa.int32()), pa.array(total[upper])], names=["cell", "g"]
        )

    out = np.zeros((d, d))
    cells = fit.mapInArrow(run, "cell int, g double").groupBy("cell").agg(F.sum("g").alias("g"))
    for cell, g in cells.collect():
        out[upper[0][cell], upper[1][cell]] = out[upper[1][cell], upper[0][cell]] = g
    return out


@dataclass
class Whitening:
    """A fit: ``whitened = (x - mean) @ axes / sqrt(variances)``, components in falling order of variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact ``sum((n * x - S) ** 2)`` of each row."""
        x = whole(x)
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * x.shape[1] > LONG_MOST:
            x = x.astype(object)
        away = self.n * x - np.array(self.sums, x.dtype)
        return [v if v <= LONG_MOST else None for v in (away * away).sum(1).tolist()]


def fit_whitening(fit: DataFrame, d: int, components: int) -> Whitening:
    """Whitening of the rows ``x`` of ``fit``, vectors of length ``d``, as floats that hold whole numbers."""
    n, sums = count_and_sums(fit, d)
    model = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    if n < 2:
        return model
    mean, factors, product = model.mean, [], np.eye(d)

    def orthogonal(x: np.ndarray) -> np.ndarray:
        q = x - mean
        for factor in factors:
            q = solve(q, factor)
        return q

    slack = 11 * (min(n, BLOCK_ROWS) * d + d * (d + 1)) * ROUNDOFF
    for step in range(PASSES):
        g = gram(fit, orthogonal, d)
        w, v = np.linalg.eigh(g)
        if w[-1] <= 0:
            return model
        none = w < 1e-12 * w[-1]
        if step > 1 and (none | (w > 0.5 * w[-1])).all():
            break
        shift = slack * w[-1] if not step or w[0] <= slack * w[-1] else 0.0
        factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
        product = factors[-1] @ product
    last = np.sqrt(np.where(none, 0, w))[:, None] * v.T if none.any() else np.linalg.cholesky(g).T
    _, values, axes = np.linalg.svd(last @ product)
    real = min(components, int((values > values[0] * d * 2 * ROUNDOFF).sum()))
    model.total = float((values**2).sum() / n)
    model.axes, model.variances = axes[:real].T, values[:real] ** 2 / n
    return model


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """Whitened coordinates of every row whose ``embedding`` is finite, one row for each component."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(finite(F.col("embedding")))
    rows = rows.select("vec_id", floored(rows, "embedding", scale).alias("x"))
    distinct = pin(rows.select("x").distinct())
    out = rows.sparkSession.createDataFrame([], OUT)
    for (d,) in sorted(distinct.select(F.size("x")).where(F.size("x") > 0).distinct().collect()):
        fit = distinct.where(F.size("x") == d)
        model = fit_whitening(fit, d, components)
        k = len(model.variances)
        if k:
            error = np.abs(gram(fit, model.apply, k) / model.n - np.eye(k)).max()
            out = out.unionByName(project(rows.where(F.size("x") == d), model, float(error)))
    return out


def project(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """All rows' whitened coordinates, in one pass without a shuffle."""
    k = len(model.variances)
    explained = model.variances / model.total

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            each = np.repeat(np.arange(m), k)
            x = matrix(batch)
            columns = [
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n, np.int64)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(model.apply(x).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            names = [field.split()[0] for field in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, OUT)
