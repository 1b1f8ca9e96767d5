"""Whitening of embeddings by the singular values of their centred rows.

Blocks of centred rows are reduced to one triangle R on the executors. On the driver, which
sees no more than R, Householder reflections make it bidiagonal, the shifted qd algorithm
finds the singular values to high relative accuracy, and twisted factorisations of the
shifted bidiagonal products give each value its direction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from stayline.operators.triangles import triangle
from stayline.session import checkpointed

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
EPS = float(np.finfo(float).eps)
TINY = 1e-290
# neighbours closer than this, relative to the larger one, are made orthogonal
CLOSE = 1e-3
BESIDE = 1e-13


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``diagonal, above, right`` with r = U B right' for an upper bidiagonal B and some rotation U."""
    a = np.array(r, dtype=float)
    n = len(a)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if size else v

    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential qd step; None if the shift is above the smallest value."""
    q_new, e_new = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        q_new[i] = max(d + e[i], TINY)
        ratio = q[i + 1] / q_new[i]
        e_new[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    q_new[-1] = d
    return np.maximum(q_new, TINY), e_new


def qd_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, in falling order."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if not scale:
        return np.zeros(len(diagonal))
    todo = [(np.maximum((diagonal / scale) ** 2, TINY), (above / scale) ** 2, 0.0)]
    found: list[float] = []
    while todo:
        q, e, moved = todo.pop()
        while len(q) > 1:
            small = np.flatnonzero(e <= EPS**2 * (moved + np.minimum(q[:-1], q[1:])))
            if len(small):
                cut = int(small[-1]) + 1
                todo.append((q[:cut], e[: cut - 1], moved))
                q, e = q[cut:], e[cut:]
                continue
            if q[0] < q[-1]:  # small values are found at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            # the smaller value of the last two rows, from which a step may fall back
            a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), e[-1], q[-1]
            half = (q[-2] + b + c) / 2
            root = np.sqrt(max(half * half - q[-2] * c, 0.0))
            shift = min(q[-2] * c / (half + root), a, c) * (1 - 4 * EPS)
            for tried in (shift, shift * 0.75, shift * 0.25, shift * 0.01, 0.0):
                step = _qd_step(q, e, tried)
                if step is not None:
                    (q, e), moved = step, moved + tried
                    break
        found.extend(q + moved)
    return np.sort(np.array(found))[::-1] * scale * scale


class _Twisted:
    """The twisted factorisation of L D L' - value, at the row where it is nearest to singular."""

    def __init__(self, d: np.ndarray, l: np.ndarray, value: float):
        n = len(d)
        self.size = abs(value) + d.max()
        nonzero = TINY * self.size
        lower, upper = np.empty(n - 1), np.empty(n - 1)
        down, up = np.empty(n), np.empty(n)
        s, p = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            down[i] = d[i] + s[i] or nonzero
            lower[i] = d[i] * l[i] / down[i]
            s[i + 1] = lower[i] * l[i] * s[i] - value
        down[-1] = d[-1] + s[-1] or nonzero
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            up[i + 1] = d[i] * l[i] ** 2 + p[i + 1] or nonzero
            ratio = d[i] / up[i + 1]
            upper[i] = l[i] * ratio
            p[i] = p[i + 1] * ratio - value
        up[0] = p[0] or nonzero
        gamma = s.copy()
        gamma[:-1] += d[:-1] / up[1:] * p[1:]
        gamma[-1] += d[-1]
        self.row = int(np.argmin(np.abs(gamma)))
        self.gamma = float(gamma[self.row])
        self.lower, self.upper = lower, upper
        self.middle = np.concatenate([down[: self.row], [self.gamma or nonzero], up[self.row + 1 :]])

    def _spread(self, w: np.ndarray) -> np.ndarray:
        x = w.copy()
        for i in range(self.row - 1, -1, -1):
            x[i] -= self.lower[i] * x[i + 1]
        for i in range(self.row, len(x) - 1):
            x[i + 1] -= self.upper[i] * x[i]
        return x

    def vector(self) -> np.ndarray:
        """The direction that the matrix maps to ``gamma`` in one row."""
        return self._spread(np.eye(len(self.middle))[self.row])

    def solve(self, b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(self.row):
            y[i + 1] -= self.lower[i] * y[i]
        for i in range(len(y) - 1, self.row, -1):
            y[i - 1] -= self.upper[i - 1] * y[i]
        least = EPS * EPS * self.size
        x = self._spread(y / np.where(np.abs(self.middle) < least, least, self.middle))
        return x / np.abs(x).max()


def _apart(z: np.ndarray, others: np.ndarray) -> np.ndarray:
    """What of a vector is orthogonal to orthonormal others; the second turn removes rounding."""
    for _ in range(2):
        z = z - others @ (others.T @ z)
    return z


def _directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of B'B of an unreduced bidiagonal B, for its falling eigenvalues."""
    n = len(diagonal)
    if n == 1:
        return np.ones((1, 1))
    least = TINY**0.5 * max(np.abs(diagonal).max(), np.abs(above).max())
    a = np.where(np.abs(diagonal) < least, least, diagonal)
    d, l = a * a, above / a[:-1]
    vectors = np.zeros((n, n))
    first = 0
    random = np.random.default_rng(n)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * values[j - 1]:
            first = j
        near = vectors[:, first:j]
        best, z = np.inf, random.standard_normal(n)
        moved = float(value)
        for _ in range(4):
            with np.errstate(all="ignore"):
                factors = _Twisted(d, l, moved)
                found = factors.vector()
                size = np.linalg.norm(found)
            if not np.isfinite(size) or abs(factors.gamma) / size >= best:
                break
            best, z = abs(factors.gamma) / size, found / size
            moved += factors.gamma / size**2
        rest = _apart(z, near)
        if near.shape[1]:
            # among close values, a direction that a neighbour has taken gives way to their
            # complement; just off the value, the factors treat all of them alike
            if np.linalg.norm(rest) < 0.5:
                rest = _apart(random.standard_normal(n), near)
            beside = _Twisted(d, l, value * (1 + BESIDE))
            for _ in range(3):
                with np.errstate(all="ignore"):
                    z = beside.solve(rest / np.linalg.norm(rest))
                rest = _apart(z / np.linalg.norm(z), near)
        vectors[:, j] = rest / np.linalg.norm(rest)
    return vectors


def principal_directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of r'r."""
    n = len(r)
    diagonal, above, right = bidiagonal(r)
    negligible = np.abs(above) <= n * EPS * max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    edges = [0, *(np.flatnonzero(negligible) + 1), n]
    values, vectors = np.empty(n), np.zeros((n, n))
    for start, end in zip(edges, edges[1:]):
        own = qd_values(diagonal[start:end], above[start : end - 1])
        values[start:end] = own
        vectors[start:end, start:end] = _directions(diagonal[start:end], above[start : end - 1], own)
    order = np.argsort(-values, kind="stable")
    return values[order], (right @ vectors)[:, order]


@dataclass(frozen=True)
class Whitening:
    """What whitens a row x of integers: (x - sums / n) on ``directions``, over the roots of ``variances``."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    directions: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v) for v in self.variances / self.trace]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of integers: 64 times each entry, rounded down, and shifted above zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(column), -1)


def usable_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, vector`` of rows whose vector is there, complete, finite and of the commonest length.

    Of equally common lengths the larger one counts; empty vectors never do.
    """
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = checkpointed(table.select(key, vector).where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite))
    lengths = whole.groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    return whole.where(F.size(vector) == most[0]["length"]) if most else whole


def fit_whitening(vectors: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows of ``usable_vectors``; None where there are none.

    Directions in which the rows do not vary (to rounding) have no whitening and are left out.
    """
    only = vectors.select(vector)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(0, np.int64), 0
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                total, n = (x.sum(axis=0) if not n else total + x.sum(axis=0)), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.int64()))], ["n", "total"])

    sums = only.mapInArrow(add, "n long, total array<long>").select("n", F.posexplode("total").alias("place", "x"))
    found = sums.groupBy("place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("place").collect()
    if not found:
        return None
    n, total = found[0]["n"], np.array([row["x"] for row in found])

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return (n * _matrix(batch.column(0)) - total) / n

    r = triangle(only, centred, len(total))
    values, directions = principal_directions(r)
    moves = np.flatnonzero(values > (len(total) * EPS) ** 2 * max(values[0], 0.0))[:components]
    return Whitening(n, total, values[moves] / n, directions[:, moves], float((r**2).sum()) / n)


def whitened_vectors(vectors: DataFrame, key: str, vector: str, fit: Whitening) -> DataFrame:
    """``key, deviation, whitened`` of every row.

    ``deviation`` is the sum of (n x - sums) squared, exact, null where a long cannot hold it;
    ``whitened`` is an array of doubles.
    """
    own = vectors.select(key, vector)
    schema = StructType(
        [own.schema[key], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]
    )

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = fit.directions / np.sqrt(fit.variances)
        for batch in batches:
            away = fit.n * _matrix(batch.column(1)) - fit.sums
            fits = (away.astype(float) ** 2).sum(axis=1) < 9e18
            white = away / fit.n @ turned
            lists = pa.ListArray.from_arrays(
                np.arange(0, white.size + 1, max(white.shape[1], 1), dtype=np.int32)[: len(white) + 1], white.ravel()
            )
            squares = pa.array((away * away).sum(axis=1), mask=~fits)
            yield pa.RecordBatch.from_arrays([batch.column(0), squares, lists], names=schema.names)

    return own.mapInArrow(turn, schema)


def identity_error(whitened: DataFrame, components: int, n: int) -> float:
    """The largest entry by which the covariance of the whitened rows differs from the identity."""

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return np.column_stack([np.ones(len(values)), values])

    # beside a constant column, the other columns' triangle is that of centred rows
    r = triangle(whitened.select("whitened"), rows, components + 1)[1:, 1:]
    return float(np.abs(r.T @ r / n - np.eye(components)).max(initial=0.0))


def whiten(table: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: the whitened value and what describes the fit.

    Columns: ``key, component`` (from 1, by falling variance), ``n`` (vectors fitted),
    ``deviation`` (see ``whitened_vectors``), ``whitened``, ``explained`` (the component's
    share of the variance) and ``identity_error`` (one value for all).

    Rows whose vector is null, empty, holds null or non-finite entries, or has another than
    the commonest length are left out. Rows that repeat, with or without their id, count as
    rows of their own; ids may be null. Components without variance are left out, so equal
    vectors, a single one or an empty table give no rows. Other columns are ignored.
    """
    vectors = usable_vectors(table, key, vector)
    fit = fit_whitening(vectors, vector, components)
    schema = vectors.select(F.col(key)).schema
    if fit is None or not len(fit.variances):
        columns = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], StructType([*schema, *StructType.fromDDL(columns)]))
    white = checkpointed(whitened_vectors(vectors, key, vector, fit))
    error = identity_error(white, len(fit.variances), fit.n)
    shares = F.array(*[F.lit(v) for v in fit.explained])
    flat = white.select(key, "deviation", F.posexplode("whitened").alias("place", "value"))
    return flat.select(
        key,
        (F.col("place") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.get(shares, "place").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
