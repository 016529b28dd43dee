"""Whitening of embeddings by their leading principal components (operator 12).

Spark makes the sums: first the mean, then the centred covariance, as partial matrices
of each task that are added up cell by cell. What reaches the driver is one d x d
matrix, bounded by the dimension alone. There Householder reflections make it
tridiagonal, Sturm counts bisect for the leading eigenvalues, inverse iteration with
reorthogonalisation within clusters gives their vectors, and the reflections bring them
back. The mean and the few components are broadcast and every row is projected.

Entries are fixed-point numbers (long), centred on the whole number next to their mean,
so products are exact and neither the order nor the split of rows changes a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of query op12: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components with a smaller share of the largest eigenvalue have no direction of their own and are left out.
FLAT = 1e-12
#: Eigenvalues closer than this share of the norm form a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
_EPS = float(np.finfo(float).eps)
#: Sums of products up to here are exact in doubles.
_EXACT = 2.0**53
_LARGEST = float(2**62)
_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """What the rows are projected with: number of rows, sums of each dimension, components (rows), their eigenvalues, trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(diagonal, off-diagonal, reflections) of Householder's reduction of the symmetric matrix a."""
    a = np.array(a, float)
    d = len(a)
    steps = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = float(np.linalg.norm(x))
        if size == 0 or not np.any(x[1:]):
            continue
        x[0] += np.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        # both sides at once: A - 2 v w' - 2 w v' with w = A v - (v' A v) v
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        w = p - (v @ p) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        steps.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), steps


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number of `at`: negative terms of the Sturm sequence."""
    least = max(np.finfo(float).tiny / _EPS, float(np.max(off * off, initial=0.0)) * np.finfo(float).tiny)
    q, count = diagonal[0] - at, np.zeros(len(at), np.int64)
    for k in range(len(diagonal)):
        if k:
            q = diagonal[k] - at - off[k - 1] ** 2 / q
        # a term of zero counts as negative, as its stand-in is
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected down to neighbouring doubles."""
    d = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    slack = 2 * _EPS * d * float(np.max(np.abs(diagonal) + reach)) + np.finfo(float).tiny
    low = np.full(k, float(np.min(diagonal - reach)) - slack)
    high = np.full(k, float(np.max(diagonal + reach)) + slack)
    rank = d - 1 - np.arange(k)  # so many eigenvalues lie below the one looked for
    while True:
        middle = low + (high - low) / 2
        if not np.any((middle > low) & (middle < high)):
            return middle
        above = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b by elimination with row exchanges; pivots of zero are raised to `least`."""
    d = len(diagonal)
    u0, u1, u2 = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    swap, factor = np.zeros(d, bool), np.zeros(d)
    for i in range(d - 1):
        below0, below1, below2 = off[i], u0[i + 1], u1[i + 1]
        if abs(below0) > abs(u0[i]):
            swap[i] = True
            (u0[i], below0), (u1[i], below1), (u2[i], below2) = (below0, u0[i]), (below1, u1[i]), (below2, u2[i])
        elif u0[i] == 0:
            u0[i] = least
        factor[i] = below0 / u0[i]
        u0[i + 1], u1[i + 1] = below1 - factor[i] * u1[i], below2 - factor[i] * u2[i]
    if abs(u0[-1]) < least:
        u0[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(d - 1):
            if swap[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(d - 1, -1, -1):
            rest = (u1[i] * x[i + 1] if i + 1 < d else 0.0) + (u2[i] * x[i + 2] if i + 2 < d else 0.0)
            x[i] = (x[i] - rest) / u0[i]
        return x

    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix for its leading eigenvalues, by inverse iteration.

    A vector is made orthogonal, at every step, to those found before in its cluster.
    Equal eigenvalues are moved apart by some units in the last place.
    """
    d = len(diagonal)
    norm = float(np.max(np.abs(diagonal)) + 2 * np.max(np.abs(off), initial=0.0)) or 1.0
    draw = np.random.default_rng(0)
    found: list[np.ndarray] = []
    start, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            start = k
        shift = min(value, shift - 4 * _EPS * norm) if k > start else value
        solve = _solver(diagonal, off, shift, _EPS * norm)
        x = draw.standard_normal(d)
        settled = 0
        for _ in range(30):
            x = x / np.linalg.norm(x)
            y = solve(x)
            y /= np.max(np.abs(y))
            for _ in range(2):
                for earlier in found[start:k]:
                    y -= (earlier @ y) * earlier
            y /= np.linalg.norm(y)
            settled = settled + 1 if abs(x @ y) > 1 - 1e-14 else 0
            x = y
            if settled == 2:
                break
        found.append(x)
    return np.array(found).reshape(len(found), d)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of a symmetric matrix: the k largest, falling, without those of no size. The largest entry of a vector is positive."""
    d = len(matrix)
    k = min(k, d)
    if k == 0 or not np.any(matrix):
        return np.zeros(0), np.zeros((0, d))
    scale = float(np.max(np.abs(matrix)))
    diagonal, off, steps = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    values = values[values > FLAT * values[0]]
    vectors = leading_vectors(diagonal, off, values)
    for at, v in reversed(steps):
        vectors[:, at:] -= 2 * np.outer(vectors[:, at:] @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    largest = np.argmax(np.abs(vectors), axis=1)
    vectors *= np.sign(vectors[np.arange(len(vectors)), largest])[:, None]
    return values * scale, vectors


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and all of its entries are finite numbers whose fixed-point form fits a long."""
    within = float(2**42)
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda e: e.isNotNull() & e.cast("double").between(-within, within)), F.lit(False))


def fixed_points(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, x): usable vectors as longs floor(1024 c) + 100000.

    Vectors that are null, hold null or not finite entries, or are of another length
    than most of the usable ones (of equals the longer) are left out; so are entries
    beyond 2 to the 42nd, which have no exact form.
    """
    good = rows.where(usable(vector))
    common = good.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    good = good.where(F.size(vector) == F.lit(common["size"] if common else 0))
    # also makes the array's elements not null
    return good.select(F.col(vec_id).alias("vec_id"), F.transform(vector, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")) + F.lit(SHIFT)).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(start, _ROWS)
            yield batch, _matrix(batch.column(column))


def products(z: np.ndarray) -> np.ndarray:
    """z' z of whole numbers, exact: by doubles where all sums are small enough, else by Python's whole numbers."""
    most = float(np.max(np.abs(z), initial=0))
    if most * most * len(z) < _EXACT:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    exact = z.astype(object)
    return exact.T @ exact


def _decimals(values: np.ndarray) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def dimension_sums(fixed: DataFrame) -> tuple[int, np.ndarray]:
    """(number of rows, exact sum of every dimension) over all rows of fixed_points()."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _blocks(batches, "x"):
            n += len(x)
            part = x.astype(object).sum(axis=0) if len(x) * float(np.max(np.abs(x), initial=0)) >= _LARGEST else x.sum(axis=0).astype(object)
            total = part if total is None else total + part
        if n:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), _decimals(total)], names=["i", "n", "s"])

    rows = fixed.select("x").mapInArrow(partial, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()  # one row for each dimension
    return (int(rows[0]["n"]) if rows else 0), np.array([int(r["s"]) for r in rows], dtype=object)


def centred_covariance(fixed: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) over all rows of fixed_points().

    Rows are centred on the whole numbers next to the means before they are multiplied;
    what is left of the means, half a unit at most, is taken out of the exact sums.
    """
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], dtype=np.int64)
    d = len(middle)
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, "x"):
            part = products(x - middle)
            total = part if total is None else total + part
        if total is not None:
            for start in range(0, len(upper[0]), 65536):
                i, j = (u[start : start + 65536] for u in upper)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(total[i, j])], names=["i", "j", "s"])

    cells = fixed.select("x").mapInArrow(partial, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # half a d x d matrix
    out = np.zeros((d, d))
    left = [int(s) - n * int(m) for s, m in zip(sums, middle, strict=True)]
    for i, j, s in cells:
        # (n * sum - left_i * left_j) / n^2 in whole numbers, rounded once
        out[i, j] = out[j, i] = (n * int(s) - left[i] * left[j]) / (n * n)
    return out


def fit(fixed: DataFrame, k: int = 8) -> Whitening | None:
    """Components of all rows of fixed_points(), which is read twice; None if it has no rows or all are equal."""
    n, sums = dimension_sums(fixed)
    if n == 0 or len(sums) == 0:
        return None
    matrix = centred_covariance(fixed, n, sums)
    values, vectors = leading_components(matrix, k)
    return Whitening(n, sums, vectors, values, float(np.trace(matrix))) if len(values) else None


def _projected(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Rows on the components, each over the square root of its eigenvalue."""
    whole = np.array([int(s) // w.n for s in w.sums], dtype=np.int64)
    rest = np.array([(int(s) % w.n) / w.n for s in w.sums])
    return (((x - whole) - rest) @ w.components.T) / np.sqrt(w.values)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for each row, exact; None beyond the range of a long."""
    top = max((abs(int(s)) for s in sums), default=0)
    most = float(np.max(np.abs(x), initial=0)) * n + top
    if most < _LARGEST:
        y = n * x - sums.astype(np.int64)
        size = float(np.max(np.abs(y), initial=0))
        if size * size * max(1, x.shape[1]) < _LARGEST:
            return (y * y).sum(axis=1).tolist()
    exact = n * x.astype(object) - sums
    return [v if v < 2**63 else None for v in (exact * exact).sum(axis=1).tolist()]


def identity_error(fixed: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity, measured on the rows."""
    k = len(w.values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for _, x in _blocks(batches, "x"):
            p = _projected(x, w)
            total += p.T @ p
            first += p.sum(axis=0)
        i, j = np.indices((k, k + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.hstack([total, first[:, None]]).ravel())], names=["i", "j", "s"])

    sums = np.zeros((k, k + 1))
    for i, j, s in fixed.select("x").mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # k x (k + 1) numbers
        sums[i, j] = s / w.n
    return float(np.max(np.abs(sums[:, :k] - np.outer(sums[:, k], sums[:, k]) - np.eye(k))))


def whiten(rows: DataFrame, k: int = 8, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): up to k rows for each usable vector.

    Components are numbered from 1 by falling eigenvalue; fewer than k where the
    dimension or the rank is smaller. Vectors that fixed_points() leaves out give no
    rows; so does a table without vectors, or with equal ones only. Repeated rows and
    ids stand for themselves, a null id stays null. deviation is null where it exceeds a
    long. Other columns are not looked at. The vectors are read four times and never
    shuffled.
    """
    fixed = fixed_points(rows, vector, vec_id)
    kind = fixed.schema["vec_id"]
    schema = T.StructType([kind, *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    w = fit(fixed, k)
    if w is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, share = identity_error(fixed, w), w.values / w.trace
    m = len(w.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, "x"):
            rows_here = len(x)
            index = pa.array(np.repeat(np.arange(rows_here), m))
            columns = [
                batch.column("vec_id").take(index), pa.array(np.tile(np.arange(1, m + 1), rows_here), pa.int32()), pa.array(np.full(rows_here * m, w.n), pa.int64()),
                pa.array(deviations(x, w.n, w.sums), pa.int64()).take(index), pa.array(_projected(x, w).ravel()), pa.array(np.tile(share, rows_here)), pa.array(np.full(rows_here * m, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return fixed.mapInArrow(project, schema)
