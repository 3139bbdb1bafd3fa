"""Embedding whitening: principal components by a pivoted Cholesky factor and one-sided Jacobi rotations.

Components are counted in steps of 1 / SCALE, so that means and deviations are exact whole numbers. The scatter of the
centred vectors is summed over tasks; its pivoted Cholesky factor is triangular, and rotations make the factor's columns
orthogonal: their squared lengths are then the scatter's eigenvalues and their directions its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborel.llm.common import PARTS, added_up, finite, pieces, stored

SCALE, SHIFT = 1024, 100_000
#: Components of a vector that a step of a task holds at once.
_CELLS = 1 << 20
#: What counts as no angle between two columns, and the most sweeps over all pairs of them.
_RIGHT, _SWEEPS = 1e-15, 60


def pivoted_cholesky(C: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with C[order][:, order] = L @ L.T; L is lower triangular and has as many columns as C has rank. The
    largest diagonal that is left goes first, until all that is left is rounding."""
    d = len(C)
    order, left = np.arange(d), C.diagonal().astype(float).copy()
    least = d * np.finfo(float).eps * left.max(initial=0.0)
    L = np.zeros((d, d))
    for k in range(d):
        p = k + int(left[k:].argmax())
        if left[p] <= least:
            return L[:, :k], order
        for x in (order, left, L):
            x[[k, p]] = x[[p, k]]
        L[k, k] = np.sqrt(left[k])
        L[k + 1 :, k] = (C[order[k + 1 :], order[k]] - L[k + 1 :, :k] @ L[k, :k]) / L[k, k]
        left[k + 1 :] -= L[k + 1 :, k] ** 2
    return L, order


def jacobi(L: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared lengths, unit rows) of L's columns after rotations of pairs that make all of them orthogonal, the longest
    first. A round turns disjoint pairs at once; rounds go as a tournament does, so that a sweep meets every pair."""
    A = np.ascontiguousarray(L.T)
    r = len(A)
    half = (r + 1) // 2
    seats = np.arange(2 * half)
    for _ in range(_SWEEPS):
        turned = False
        for _ in range(2 * half - 1):
            a, b = seats[:half], seats[half:][::-1]
            real = (a < r) & (b < r)
            a, b = np.minimum(a, b)[real], np.maximum(a, b)[real]
            x, y = A[a], A[b]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            at = np.flatnonzero(np.abs(xy) > _RIGHT * np.sqrt(xx) * np.sqrt(yy))
            if len(at):
                turned = True
                q = (yy[at] - xx[at]) / (2 * xy[at])
                t = np.where(q < 0, -1.0, 1.0) / (np.abs(q) + np.hypot(1, q))
                c = (1 / np.hypot(1, t))[:, None]
                s = c * t[:, None]
                A[a[at]], A[b[at]] = c * x[at] - s * y[at], s * x[at] + c * y[at]
            seats = np.concatenate((seats[:1], np.roll(seats[1:], 1)))
        if not turned:
            break
    size = (A * A).sum(1)
    order = np.argsort(-size, kind="stable")
    return size[order], A[order] / np.sqrt(size[order])[:, None]


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of a positive semi-definite matrix, the largest first, without those of
    zero. Of either sign of a vector that whose largest entry is positive."""
    L, order = pivoted_cholesky(scatter)
    values, rows = jacobi(L)
    vectors = np.zeros_like(rows)
    vectors[:, order] = rows
    most = np.abs(vectors).argmax(1)
    return values, vectors * np.sign(vectors[np.arange(len(vectors)), most])[:, None]


def _safe(x: np.ndarray, factor: float) -> np.ndarray:
    """x, as Python's whole numbers if sums of factor times as much could leave 64 bits."""
    return x.astype(object) if float(np.abs(x.astype(float)).max(initial=0.0)) * factor >= 2.0**62 else x


def counted(X: np.ndarray) -> np.ndarray:
    """Components as whole numbers."""
    return np.floor(X * SCALE).astype(np.int64) + SHIFT


def _slices(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of bounded size of rows of equal length, and their vectors as a matrix."""
    for batch in batches:
        vectors = batch.column(batch.schema.get_field_index(name))
        sizes = pa.compute.list_value_length(vectors).to_numpy()
        for d in np.unique(sizes).tolist():
            of = batch.filter(pa.array(sizes == d))
            step = max(1, _CELLS // d)
            for a in range(0, len(of), step):
                part = of.slice(a, step)
                yield part, part.column(of.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def takes_part(vector: Column) -> Column:
    """Whether a vector is fit for whitening: no null, not empty, no null or non-finite component, none beyond what a
    whole number of 64 bits counts."""
    return finite(vector) & F.coalesce(F.forall(vector, lambda x: F.abs(x) < 2.0**62 / SCALE), F.lit(False))


def fit(vectors: DataFrame, *, vector_col: str = "embedding", most: int = 8) -> dict | None:
    """Number, sums, and the components of the largest variances (up to most, of a variance above zero) of all vectors of
    the most frequent length; None without any. Two passes: whole sums first, then the scatter of what is left of each
    vector without the mean. Tasks hand on sums, so the driver gets one matrix, whose size is that of a vector squared."""
    of = vectors.select(F.col(f"`{vector_col}`").alias("v")).where(takes_part(F.col("v")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for _, X in _slices(batches, "v"):
            x = counted(X)
            now = total.setdefault(x.shape[1], [0, 0])
            now[0] += len(x)
            now[1] = now[1] + _safe(x, len(x)).sum(0).astype(object)
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(list(map(Decimal, s.tolist())), pa.decimal128(38, 0))], names=["dim", "place", "n", "total"])

    found = of.mapInArrow(sums, "dim int, place int, n long, total decimal(38,0)").groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    first = found.where("place = 0").orderBy(F.desc("n"), "dim").first()
    if first is None:
        return None
    dim, n = first["dim"], first["n"]
    S = np.array([int(r["total"]) for r in found.where(F.col("dim") == dim).orderBy("place").collect()], object)
    shared = vectors.sparkSession.sparkContext.broadcast((dim, n, S))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, n, S = shared.value
        C = np.zeros((dim, dim))
        for _, X in _slices(batches, "v"):
            if X.shape[1] == dim:
                y = apart(counted(X), n, S).astype(float) / n
                C += y.T @ y
        yield pieces(C.ravel())

    C = added_up(of.mapInArrow(scatter, PARTS), dim * dim).reshape(dim, dim)
    values, rows = components((C + C.T) / 2)
    return {"n": n, "sums": S, "dim": dim, "values": values[:most] / n, "rows": rows[:most], "explained": (values / max(np.trace(C), np.finfo(float).tiny))[:most]}


def apart(x: np.ndarray, n: int, S: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    x = _safe(x, 2 * n)
    wide = x.dtype == object or max(map(abs, S)) >= 1 << 62
    return x.astype(object) * n - S if wide else x * n - S.astype(np.int64)


def whitened(vectors: DataFrame, model: dict | None, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, deviation, whitened) of every row that takes part: the exact sum of (n * x - S) squared, and the projections on
    the model's components, each over the root of its variance."""
    kind = dict(vectors.dtypes)[id_col]
    of = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).where(takes_part(F.col("v")))
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, X in _slices(batches, "v") if m else ():
            if X.shape[1] == m["dim"]:
                z = apart(counted(X), m["n"], m["sums"])
                far = (_safe(z, float(np.abs(z.astype(float)).max()) * m["dim"]) ** 2).sum(1).tolist()
                w = (z.astype(float) / m["n"]) @ m["rows"].T / np.sqrt(m["values"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x if x < 1 << 63 else None for x in far], pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    return of.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """id_col, component (from 1, by falling variance), n, deviation, whitened, explained and identity_error of every row
    that takes part and each of the components, up to most.

    Components become x = floor(SCALE * c) + SHIFT. deviation: the exact sum of (n * x - S) squared over the dimensions, for n vectors
    with sums S; null if beyond 64 bits. whitened: x without its mean, projected on a unit eigenvector of the covariance
    and divided by the root of its eigenvalue. explained: the eigenvalue's share of all variance. identity_error: how far
    the covariance of the rows' whitened values is from the identity at most.

    Vectors that are null, empty, hold null or non-finite components or ones beyond 2 ** 52, or have another length than
    most, take no part. Components of no variance are left out: one vector, or copies of one, give no rows, nor does an
    empty table. Repeated rows count each, rows with a null id too; other columns are not used.
    """
    model = fit(vectors, vector_col=vector_col, most=most)
    rows = stored(whitened(vectors, model, id_col=id_col, vector_col=vector_col))
    k = len(model["rows"]) if model else 0
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # covar_pop centres while it goes
    found = rows.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs)).first() if pairs else ()
    error = max((abs(x - (i == j)) for x, (i, j) in zip(found, pairs, strict=True)), default=0.0)
    shares = F.array(*map(F.lit, model["explained"].tolist())) if k else F.array().cast("array<double>")
    each = rows.select("id", "deviation", F.posexplode("whitened").alias("place", "value"))
    return each.select(F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.lit(model["n"] if model else 0).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), F.get(shares, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"))
