"""Whitening of vectors by contour integration (FEAST).

Vectors become whole numbers (``floor(scale * entry)``), so counts, sums and deviations are exact.  The fit list holds each distinct vector once.  Tasks add up
sums, then products of vectors centred at the exact mean; only a matrix of dimensions by dimensions reaches the driver, whatever the number of rows.

Eigenpairs of that covariance come from intervals of the spectrum.  Householder reflections give a tridiagonal matrix of the same spectrum, and the signs of its pivots
at a shift (inertia) count the eigenvalues above it, so bisection cuts the spectrum, from its top, into intervals with few eigenvalues each.  For an interval, the
resolvent is integrated along the circle over it by Gauss-Legendre quadrature: one complex shifted solve a node gives the projection of a random block onto the
eigenvectors inside.  Rayleigh-Ritz on that block extracts them; this repeats until residuals vanish.  The interval is done when it holds as many as the inertia counted, so none is missed.

Defined results: vectors that are null, empty, of another length than the commonest one (ties: the longest), or with null, non-finite or too large entries
(``LIMIT``) take no part; rows without an id and repeated rows are rows like others, and count once in the fit list; components without variance
are left out; with fewer dimensions than components asked for there are fewer; no vectors give no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import cut

LIMIT = 1 << 40  # Whole-number entries stay below this.
BLOCK = 4096  # Vectors centred and multiplied at once.
NODES = 12
CROWD = 16  # Eigenvalues of one interval at most, unless they lie too close to be told apart.
ROUNDS = 30


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the spectrum of symmetric ``a``, by Householder reflections."""
    a, n = a.copy(), len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        if length == 0:
            continue
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diagonal: np.ndarray, beside: np.ndarray, shift: float) -> int:
    """Number of eigenvalues over ``shift``: by Sylvester's law that of positive pivots of the shifted matrix."""
    count, pivot = 0, 1.0
    tiny = np.finfo(float).tiny ** 0.5
    squares = np.concatenate([[0.0], beside * beside])
    for d, b2 in zip((diagonal - shift).tolist(), squares.tolist(), strict=True):
        pivot = d - b2 / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def project(v: np.ndarray, centre: float, radius: float, q: np.ndarray) -> np.ndarray:
    """``q`` projected onto the eigenvectors of ``v`` with eigenvalues inside the circle, by quadrature of the resolvent over its upper half."""
    place, weight = np.polynomial.legendre.leggauss(NODES)
    out, eye = np.zeros_like(q), np.eye(len(v))
    for t, w in zip(place, weight, strict=True):
        turn = radius * np.exp(0.5j * np.pi * (t + 1))
        out += 0.5 * w * (turn * np.linalg.solve((centre + turn) * eye - v, q.astype(complex))).real
    return out


def inside(v: np.ndarray, low: float, high: float, count: int, seed: int = 3) -> np.ndarray:
    """The ``count`` eigenvectors of ``v`` in the interval; an error if subspace iteration finds another number."""
    n = len(v)
    size = np.abs(v).sum(axis=1).max()
    q = np.random.default_rng(seed).standard_normal((n, min(n, count + max(4, count // 2))))
    centre, radius = (low + high) / 2, (high - low) / 2
    settled = False
    for _ in range(ROUNDS):
        q, _r = np.linalg.qr(project(v, centre, radius, np.linalg.qr(q)[0]))
        small = q.T @ v @ q
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        q = q @ turn
        own = np.flatnonzero((ritz > low) & (ritz <= high))
        left = np.linalg.norm(v @ q[:, own] - q[:, own] * ritz[own], axis=0)
        if len(own) == count and (left <= 1e-13 * size * np.sqrt(n)).all():
            if settled:
                return q[:, own]
            settled = True  # one more round, for the last digits
    raise ArithmeticError(f"{len(own)} of {count} eigenvalues settled between {low} and {high}")


def nth(diagonal: np.ndarray, beside: np.ndarray, j: int, low: float, high: float) -> float:
    """The ``j``-th largest eigenvalue, by bisection on the inertia, from ``low`` to ``high`` (``low`` if there are fewer above it)."""
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high or high - low <= 1e-12 * abs(high):
            break
        low, high = (middle, high) if above(diagonal, beside, middle) >= j else (low, middle)
    return low


def eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest positive eigenvalues of symmetric ``v``, falling, and their unit eigenvectors as columns."""
    n = len(v)
    size = float(np.abs(v).sum(axis=1).max()) if n else 0.0
    vectors = np.zeros((n, 0))
    if not size:
        return np.zeros(0), vectors
    diagonal, beside = tridiagonal(v)
    nothing = n * np.finfo(float).eps * size  # below this an eigenvalue is rounding
    positive = above(diagonal, beside, nothing)
    k, done, high = min(k, positive), 0, size * (1 + 1e-9)
    while done < k:
        # Ends lie in wide gaps, so what is outside is well damped by the quadrature.
        edges, cut_at, crowd = [nth(diagonal, beside, done + 1, nothing, high)], 0, CROWD
        while not cut_at:
            most = min(positive - done, crowd)
            edges += [nth(diagonal, beside, done + j, nothing, high) for j in range(len(edges) + 1, most + 2)]
            gaps = -np.diff(edges)
            seen = gaps > max(1e-9 * edges[0], 50 * nothing)  # not rounding
            if seen.any():
                # The most eigenvalues, though not more than asked for, with a gap that is wide beside their interval.
                good = np.flatnonzero(seen & (gaps >= 0.2 * (edges[0] - np.array(edges[1:])))) + 1
                good = good if len(good) else np.flatnonzero(seen) + 1
                enough = good[good <= k - done]
                cut_at = int(enough[-1] if len(enough) else good[0])
            elif most < positive - done:
                crowd *= 2  # too close together to be told apart: taken as one
            else:
                cut_at = most
        low = (edges[cut_at - 1] + edges[cut_at]) / 2
        top = min(high, edges[0] + max(edges[cut_at - 1] - low, 1e-9 * edges[0]))
        count = above(diagonal, beside, low) - above(diagonal, beside, top)
        if count != cut_at:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {top}, {cut_at} expected")
        vectors = np.column_stack([vectors, inside(v, low, top, count)])
        done, high = done + count, low
    # Once more over all intervals, so that vectors of different ones are orthogonal to the last digit.
    q = np.linalg.qr(vectors)[0]
    small = q.T @ v @ q
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1][:k], (q @ turn)[:, ::-1][:, :k]


def stacked(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as a matrix."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return np.asarray(flat).astype(np.int64, copy=False).reshape(-1, d)


def whole_vectors(df: DataFrame, ids: str, vector: str, scale: int) -> DataFrame:
    """``id`` and ``x`` (whole numbers) of the rows that take part."""
    rows = df.select(F.col(ids).alias("id"), F.col(vector).alias("c")).where("size(c) > 0")
    x = rows.where(F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double") * scale) < LIMIT)))
    x = x.select("id", F.transform("c", lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("x"))
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.where(F.size("x") == (length["d"] if length else 0))


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column("x"), d)
            yield pa.record_batch({"n": pa.array([len(x)]), "s": pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))})

    return run


def _products(d: int, mean: np.ndarray, turn: np.ndarray | None):
    """A task's sum of outer products of centred vectors, turned by ``turn`` if given: a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = 0.0, False
        for batch in batches:
            x = stacked(batch.column("x"), d)
            for at in range(0, len(x), BLOCK):
                y = x[at : at + BLOCK] - mean
                y = y if turn is None else y @ turn
                total, any_row = total + y.T @ y, True
        if any_row:
            yield pa.record_batch({"i": pa.array(np.arange(len(total), dtype=np.int32)), "row": pa.array(total.tolist(), pa.list_(pa.float64()))})

    return run


def covariance(fit: DataFrame, n: int, mean: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor ``n``) of the fit list, or of its vectors after ``turn``."""
    k = len(mean) if turn is None else turn.shape[1]
    parts = fit.select("x").mapInArrow(_products(len(mean), mean, turn), "i int, row array<double>")
    out = np.zeros((k, k))
    for r in parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = r["v"] / n
    return (out + out.T) / 2


@dataclass
class Whitening:
    """``n`` distinct vectors with exact sums, the components (columns of ``vectors``) and how far the whitened fit list is from unit covariance."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # one rounding each

    @property
    def turn(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = 4) -> Whitening:
    """The whitening of rows with whole-number vectors ``x`` of one length."""
    distinct = cut(vectors.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    first = distinct.first()
    if first is None:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), 0.0)
    d = len(first["x"])
    parts = distinct.mapInArrow(_sums(d), "n long, s array<long>")
    by = parts.select("n", F.posexplode("s").alias("j", "s")).groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()  # one row a dimension
    n, sums = int(by[0]["n"]), [int(r["s"]) for r in by]
    out = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), 0.0)
    v = covariance(distinct, n, out.mean)
    out.trace = float(np.trace(v))
    out.values, out.vectors = eigenpairs(v, components)
    if len(out.values):
        out.identity_error = float(np.abs(covariance(distinct, n, out.mean, out.turn) - np.eye(len(out.values))).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of ``(n * x - S)**2``; null where they exceed a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if len(sums) * most * most < 1 << 63:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    gap = x.astype(object) * n - np.array(sums, dtype=object)
    return [t if t < 1 << 63 else None for t in (gap * gap).sum(axis=1).tolist()]


WHITE = "id long, component int, deviation long, whitened double"


def transform(vectors: DataFrame, w: Whitening) -> DataFrame:
    """``id``, ``component`` (from 1), ``deviation`` and ``whitened`` of every row with ``id`` and ``x``."""
    d, k, mean, turn, n, sums = len(w.sums), len(w.values), w.mean if w.n else None, w.turn, w.n, w.sums
    if not k:
        return vectors.sparkSession.createDataFrame([], WHITE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column("x"), d)
            row = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch(
                {
                    "id": batch.column("id").take(pa.array(row)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(row)),
                    "whitened": pa.array(((x - mean) @ turn).reshape(-1)),
                }
            )

    return vectors.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(run, WHITE)
