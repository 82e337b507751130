"""Embedding whitening: vectors on their leading principal axes, every axis scaled to unit variance.

Entries c become whole numbers x = floor(64 * c) + 1000000, so that sums are exact. Two passes in Spark give the sums
and the centred covariance: tasks add up their rows, and the entries of these partial matrices are summed by a shuffle.
What comes to the driver is one d x d matrix, whatever the number of rows. There it is brought to tridiagonal form by
Householder reflections; the leading eigenvalues are bracketed by Sturm counts and bisected; their vectors come from
inverse iteration, orthogonalised inside clusters of close eigenvalues, and are turned back by the reflections. The
components (k x d numbers) travel with the projection to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.llm.common import record_of

SCALE = 64.0
SHIFT = 1_000_000
COMPONENTS = 32
#: Beyond this size whole numbers of a batch are handled as Python's, which do not overflow.
SMALL = 1 << 31
LONGEST = (1 << 63) - 1
EPS = float(np.finfo(np.float64).eps)


def complete(embedding: str) -> Column:
    """Not null, and without null or non-finite entries."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(F.forall(F.col(embedding), finite), F.lit(False))


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000, as int64 or, for huge entries, as Python integers; 64 * c stops at the range of longs."""
    floors = np.floor(np.asarray(entries, np.float64) * SCALE)
    if not floors.size or np.abs(floors).max() < SMALL:
        return floors.astype(np.int64) + SHIFT
    big = np.array([max(-LONGEST, min(LONGEST, int(v))) + SHIFT if np.isfinite(v) else (LONGEST if v > 0 else -LONGEST) + SHIFT
                    for v in floors.ravel()], object)
    return big.reshape(floors.shape)


@dataclass(frozen=True)
class Axes:
    """What whitens vectors of one dimension: n fitted vectors, their exact sums, components (k x d), eigenvalues, trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        return _deviations(self.n, self.sums, x)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64) @ self.components.T / np.sqrt(self.eigenvalues)


def _deviations(n: int, sums: tuple[int, ...], x: np.ndarray) -> np.ndarray:
    most = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    if n * most < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        return n * x.astype(np.int64) - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squared_lengths(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null beyond the range of longs."""
    if deviations.dtype != object and deviations.size:
        most = int(np.abs(deviations).max())
        if most * most * deviations.shape[1] <= LONGEST:
            return (deviations * deviations).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in deviations]
    return [v if v <= LONGEST else None for v in exact]


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, subdiagonal and Householder vectors (from row, unit vector) of a symmetric matrix."""
    a = np.array(matrix, np.float64)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0.0 or np.linalg.norm(x[1:]) == 0.0:
            continue
        x[0] += np.copysign(norm, x[0])
        v = x / np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = 2.0 * (rest @ v)
        w = p - (p @ v) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        column = a[k + 1 :, k]
        column -= 2.0 * (v @ column) * v
        a[k, k + 1 :] = column
        reflections.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are smaller than each shift."""
    largest = max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), 1e-300)
    tiny = EPS * largest * 1e-3
    q = diagonal[0] - shifts
    count = (q < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diagonal[i] - shifts - off[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bracket cannot be halved further."""
    d = len(diagonal)
    radius = np.r_[np.abs(off), 0.0] + np.r_[0.0, np.abs(off)]
    low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
    margin = max(abs(low), abs(high), 1e-300) * 1e-10
    rank = d - 1 - np.arange(k)  # how many eigenvalues lie below the wanted one
    a, b = np.full(k, low - margin), np.full(k, high + margin)
    for _ in range(200):
        middle = (a + b) / 2
        if np.all((middle <= a) | (middle >= b)):
            break
        over = below(diagonal, off, middle) > rank
        b, a = np.where(over, middle, b), np.where(over, a, middle)
    return (a + b) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) y = right by elimination with partial pivoting; pivots of zero become tiny."""
    d = len(diagonal)
    main, upper, second = diagonal - shift, np.r_[off, 0.0], np.zeros(d)
    y = right.copy()
    for i in range(d - 1):
        lower = off[i]
        if abs(lower) > abs(main[i]):
            factor = main[i] / lower
            old_main, old_upper = main[i + 1], upper[i + 1]
            next_main, next_upper = upper[i] - factor * old_main, -factor * old_upper
            main[i], upper[i], second[i] = lower, old_main, old_upper
            main[i + 1], upper[i + 1] = next_main, next_upper
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            if abs(main[i]) < tiny:
                main[i] = tiny
            factor = lower / main[i]
            main[i + 1] -= factor * upper[i]
            y[i + 1] -= factor * y[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for i in range(d - 1, -1, -1):
        if i + 1 < d:
            y[i] -= upper[i] * y[i + 1]
        if i + 2 < d:
            y[i] -= second[i] * y[i + 2]
        y[i] /= main[i]
    return y


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors (rows) of a tridiagonal matrix for falling eigenvalues, by inverse iteration.

    Values closer than a thousandth of the matrix's norm form a cluster; a vector is kept orthogonal to those of its
    cluster in every step, and values that agree are shifted apart by a few units of rounding.
    """
    norm = max(float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)), 1e-300)
    rng = np.random.default_rng(5)
    found: list[np.ndarray] = []
    start, shift = 0, 0.0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            start = i
        shift = min(float(value), shift - 4 * EPS * norm) if i > start else float(value)
        vector = rng.normal(size=len(diagonal))
        for _ in range(6):
            vector /= np.abs(vector).max()
            vector = _solve(diagonal, off, shift, vector, EPS * norm)
            for _ in range(2):
                for other in found[start:]:
                    vector -= (other @ vector) * other
            vector /= np.linalg.norm(vector)
        found.append(vector)
    return np.array(found).reshape(len(values), len(diagonal))


def principal_axes(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the up to k largest eigenvalues that differ from zero beyond rounding."""
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, off, min(k, len(matrix)))
    values = values[values > len(matrix) * EPS * max(float(np.trace(matrix)), 0.0)]
    vectors = eigenvectors(diagonal, off, values)
    for at, v in reversed(reflections):
        part = vectors[:, at:]
        part -= 2.0 * np.outer(part @ v, v)
    if len(values):  # the Rayleigh quotient doubles the digits that bisection left open
        values = np.einsum("ij,jk,ik->i", vectors, matrix, vectors) / np.einsum("ij,ij->i", vectors, vectors)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[order]
    return values, vectors


def _matrices(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions, entries as matrix) of the list column, dimension by dimension."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out.append((int(d), rows, flat[starts[rows][:, None] + np.arange(d)]))
    return out


def _partial_sums(vectors: DataFrame) -> DataFrame:
    """(d, i, n, s): per task, dimension and coordinate the number of vectors and the sum of x, as exact decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, rows, entries in _matrices(batch.column(0)):
                n, s = totals.get(d, (0, np.zeros(d, object)))
                totals[d] = n + len(rows), s + whole_numbers(entries).sum(axis=0).astype(object)
        for d, (n, s) in totals.items():
            yield pa.RecordBatch.from_pydict(
                {"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
                 "s": pa.array([str(int(v)) for v in s], pa.string())})

    return vectors.mapInArrow(run, "d int, i int, n long, s string")


def _covariances(vectors: DataFrame, rows_of: Callable[[int, np.ndarray], np.ndarray], sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Sums of outer products of ``rows_of(d, x)`` over all vectors, by dimension d; ``sizes`` has the width of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, entries in _matrices(batch.column(0)):
                if sizes.get(d):
                    y = rows_of(d, whole_numbers(entries))
                    totals[d] = totals.get(d, 0.0) + y.T @ y
        for d, c in totals.items():
            k = len(c)
            at = np.arange(k * k)
            yield pa.RecordBatch.from_pydict(
                {"d": pa.array(np.full(k * k, d, np.int32)), "at": pa.array(at.astype(np.int32)), "v": pa.array(c.ravel())})

    summed = vectors.mapInArrow(run, "d int, at int, v double").groupBy("d", "at").agg(F.sum("v").alias("v"))
    out = {d: np.zeros((k, k)) for d, k in sizes.items()}
    for r in summed.toLocalIterator():
        out[r["d"]].flat[r["at"]] = r["v"]
    return out


def _usable(vectors: DataFrame, embedding: str) -> DataFrame:
    return vectors.filter(complete(embedding)).select(F.col(embedding).cast("array<double>").alias("x"))


def fit(vectors: DataFrame, embedding: str = "embedding", k: int = COMPONENTS) -> dict[int, Axes]:
    """Axes by dimension; vectors of differing lengths are fitted apart. Empty vectors have none, equal vectors neither.

    Null vectors and vectors with null or non-finite entries take no part; repeated rows count each time.
    """
    x = _usable(vectors, embedding)
    sums: dict[int, dict[int, int]] = {}
    counts: dict[int, int] = {}
    totals = _partial_sums(x).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    for r in totals.toLocalIterator():
        sums.setdefault(r["d"], {})[r["i"]] = int(r["s"])
        counts[r["d"]] = r["n"]
    fitted = {d: tuple(s[i] for i in range(d)) for d, s in sums.items()}

    def centred(d: int, rows: np.ndarray) -> np.ndarray:
        return (_deviations(counts[d], fitted[d], rows) / counts[d]).astype(np.float64)

    out = {}
    for d, c in _covariances(x, centred, {d: d for d in fitted}).items():
        covariance = (c + c.T) / (2 * counts[d])
        values, axes = principal_axes(covariance, k)
        out[d] = Axes(counts[d], fitted[d], axes, values, float(np.trace(covariance)))
    return out


def identity_errors(vectors: DataFrame, axes: dict[int, Axes], embedding: str = "embedding") -> dict[int, float]:
    """By dimension, the largest absolute entry of the whitened vectors' covariance minus the identity.

    The deviations n * x - sums add up to zero exactly, so whitened vectors are centred as they are.
    """
    sizes = {d: len(a.eigenvalues) for d, a in axes.items() if len(a.eigenvalues)}
    found = _covariances(_usable(vectors, embedding), lambda d, x: axes[d].project(axes[d].deviations(x)), sizes)
    return {d: float(np.abs(c / axes[d].n - np.eye(len(c))).max()) for d, c in found.items()}


def whiten(vectors: DataFrame, axes: dict[int, Axes], embedding: str = "embedding") -> DataFrame:
    """(record, n, deviation, whitened): the input row as a struct, the number of vectors fitted, the exact squared length of
    n * x - sums (null beyond the range of longs), and the whitened vector with an entry for each component.

    Rows whose vector is null, or holds null or non-finite entries, or has a length that was not fitted, are left out.
    """
    rows = vectors.filter(complete(embedding))
    rows = record_of(rows).select("record", F.col(f"record.`{embedding}`").cast("array<double>").alias("x"))
    schema = T.StructType([
        rows.schema["record"], T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, entries in _matrices(batch.column(1)):
                if d not in axes:
                    continue
                off = axes[d].deviations(whole_numbers(entries))
                w = axes[d].project(off)
                k = w.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * np.int32(k)), pa.array(w.ravel()))
                columns = [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), axes[d].n)),
                           pa.array(_squared_lengths(off), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
