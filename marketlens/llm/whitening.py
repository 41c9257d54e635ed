"""Embedding whitening by QDWH spectral divide and conquer.

Three passes over the distinct integer vectors give their number and sums, their covariance (centred before
multiplying) and, at the end, the covariance of the whitened vectors, which is what the result is judged by. Tasks hand
on one matrix of dimension x dimension each, and Spark adds them up row by row.

The covariance is split without any eigensolver: the orthogonal polar factor U of the shifted matrix A - s*I (by
dynamically weighted Halley iterations on QR factors) has eigenvalues 1 above the shift and -1 below, so (U + I)/2
projects onto the subspace of the eigenvalues above s. A basis of it and of its complement splits A into two smaller
matrices, which are split in turn down to single components. Matrices whose entries beyond the diagonal vanish against
the whole are done. The driver's work depends on the dimension alone; the components are then broadcast with the tasks'
closure and every row is projected where it stands, without a shuffle.

Results for odd rows: vectors that are null or hold null, NaN or infinite components are dropped. Components beyond
``LARGEST / scale`` count as it. Rows of another length than the row of the least id stay, with null results, and the
fit doesn't see them. Repeated rows are fitted once and whitened each. Components without variance (below 1e-12 of the
whole) get ``whitened`` 0 and no part in ``identity_error``. ``deviation`` is null where it doesn't fit a long. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import fresh_names, hold, ship

#: Components as integers, before the offset, stay within this.
LARGEST = 1 << 30
OFFSET = 1_000_000
#: Rows that a task multiplies at once.
BLOCK = 8_192
_EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    x = a / np.linalg.norm(a)
    eye, low = np.eye(n), _EPS
    for _ in range(60):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        wa = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if moved <= 4 * _EPS ** (1 / 3) and abs(1 - low) < 1e-8:
            break
    return x


def _basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement: columns of its largest remainders, then QR."""
    left, chosen = projector.copy(), []
    for _ in range(rank):
        k = int(np.argmax(np.einsum("ij,ij->j", left, left)))
        q = left[:, k] / np.linalg.norm(left[:, k])
        chosen.append(k)
        left = left - np.outer(q, q @ left)
    q, _ = np.linalg.qr(projector[:, chosen], mode="complete")
    return q[:, :rank], q[:, rank:]


def components(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    n = len(cov)
    whole = np.linalg.norm(cov)
    vectors = np.zeros((n, n))
    done, stack = 0, [(cov, np.eye(n))]
    while stack:
        a, v = stack.pop()
        beyond = a - np.diag(np.diag(a))
        apart = len(a) > 1 and np.linalg.norm(beyond) > max(len(a) * 1e-2 * whole, np.linalg.norm(a)) * _EPS
        bases = _split(a) if apart else None
        if bases is None:
            vectors[:, done : done + len(a)] = v
            done += len(a)
            continue
        for basis in bases:
            part = basis.T @ a @ basis
            stack.append(((part + part.T) / 2, v @ basis))
    vectors, _ = np.linalg.qr(vectors)  # orthonormal to the last bit; signs are free
    values = np.einsum("ij,ij->j", vectors, cov @ vectors)
    order = np.argsort(-values, kind="stable")
    return np.maximum(values[order], 0.0), vectors[:, order]


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces that a shift between the eigenvalues parts; None if they are one to rounding.

    A shift close to an eigenvalue gives an unclean projector, so others are tried until the two sides don't mix.
    """
    diagonal, n = np.sort(np.diag(a)), len(a)
    mean, median = diagonal.mean(), (diagonal[(n - 1) // 2] + diagonal[n // 2]) / 2
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)  # the standard deviation of the eigenvalues
    best = None
    for shift in (median, *(mean + k * spread for k in (0, 0.05, -0.05, 0.23, -0.23, 0.61, -0.61))):
        shifted = a - shift * np.eye(n)
        if np.linalg.norm(shifted) <= _EPS * np.linalg.norm(a):
            continue
        projector = (polar(shifted) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        one, two = _basis(projector, rank)
        left_over = np.linalg.norm(two.T @ a @ one)
        if left_over <= 10 * n * _EPS * np.linalg.norm(a):
            return one, two
        if best is None or left_over < best[0]:
            best = left_over, one, two
    return best and best[1:]


@dataclass(frozen=True)
class Whitening:
    """What whitens a row x (integers): ``(x - sums/n) @ vectors / sqrt(values)``."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums/n, rounded once."""
        if max(map(abs, self.sums), default=0) + self.n * (LARGEST + OFFSET) < 1 << 62:
            return (x * self.n - np.array(self.sums, np.int64)) / self.n
        mean = [divmod(s, self.n) for s in self.sums]
        return (x - np.array([m[0] for m in mean], np.int64)) - np.array([m[1] / self.n for m in mean])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n*x - sums)^2."""
        sums, d = np.array(self.sums, object), x.shape[1]
        off = int(max((abs(int(x.max(initial=0)) * self.n - s) for s in self.sums), default=0)) + int(max((abs(int(x.min(initial=0)) * self.n - s) for s in self.sums), default=0))
        if off * off * d < 1 << 62:
            u = x * self.n - sums.astype(np.int64)
            return (u * u).sum(1).tolist()
        exact = ((x.astype(object) * self.n - sums) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in exact]

    def white(self, x: np.ndarray) -> np.ndarray:
        size = np.where(self.explained > 1e-12, np.sqrt(self.values), np.inf)
        return self.centred(x) @ self.vectors / size


def integers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * component) of a vector without null or non-finite components; null for other vectors."""
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    near = lambda v: F.greatest(F.least(v.cast("double"), F.lit(LARGEST / scale)), F.lit(-LARGEST / scale))
    return F.when(whole, F.transform(vector, lambda v: F.floor(near(v) * F.lit(float(scale))).cast("int")))


def _rows(b: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    at = b.column(b.schema.get_field_index(column))
    return at.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64) + OFFSET


def _products(distinct: DataFrame, x: str, width: int, of) -> np.ndarray:
    """The sum over all rows of outer products of ``of(row)``, added up in tasks and then row by row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            rows = _rows(b, x, width)
            for k in range(0, len(rows), BLOCK):
                u = of(rows[k : k + BLOCK])
                total = u.T @ u if total is None else total + u.T @ u
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "line": pa.array(total.tolist(), pa.list_(pa.float64()))})

    found = distinct.mapInArrow(run, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "v"))
    got = found.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # dimension x dimension values
    size = 1 + max((r.i for r in got), default=-1)
    out = np.zeros((size, size))
    for r in got:
        out[r.i, r.j] = r.v
    return (out + out.T) / 2


def _totals(distinct: DataFrame, x: str, width: int) -> tuple[int, tuple[int, ...]]:
    each = [F.sum((F.col(x)[i].cast("long") + OFFSET).cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    r = distinct.agg(F.count(F.lit(1)).alias("n"), *each).first()
    return r.n, tuple(int(r[f"s{i}"] or 0) for i in range(width))


def fit(vectors: DataFrame, x: str, width: int, most: int = 16) -> Whitening:
    """Learns from the distinct rows of ``x``, which all have ``width`` components."""
    ship(vectors.sparkSession)
    distinct = hold(vectors.select(x).distinct())
    try:
        n, sums = _totals(distinct, x, width)
        base = Whitening(n, sums, np.ones(width), np.eye(width), np.ones(width))
        cov = _products(distinct, x, width, base.centred) / n
        trace = float(np.trace(cov))
        values, axes = components(cov) if trace > 0 else (np.zeros(width), np.eye(width))
        values, axes = values[:most], axes[:, :most]
        part = values / trace if trace > 0 else np.zeros(len(values))
        w = Whitening(n, sums, values, axes, part)
        live = np.flatnonzero(part > 1e-12)
        got = _products(distinct, x, width, w.white) / n
        error = float(np.abs(got[np.ix_(live, live)] - np.eye(len(live))).max(initial=0.0))
        return Whitening(n, sums, values, axes, part, error)
    finally:
        distinct.unpersist()


def apply(vectors: DataFrame, x: str, w: Whitening, white: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Adds ``white`` (array<double>, one for each component) and ``deviation`` (long); both null where ``x`` is."""
    ship(vectors.sparkSession)
    keep = [c for c in vectors.columns if c not in (white, deviation)]
    schema = T.StructType([*(vectors.schema[c] for c in keep), T.StructField(white, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.LongType())])
    width, many = w.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index
            known = b.column(at(x)).is_valid().to_numpy(zero_copy_only=False)
            rows = _rows(b.filter(pa.array(known)), x, width)
            flat = pa.array(w.white(rows).ravel())
            ends = pa.array(np.concatenate([[0], np.cumsum(np.where(known, many, 0))]).astype(np.int32), mask=np.append(~known, False))
            off = iter(w.deviation(rows))
            far = pa.array([next(off) if k else None for k in known], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(at(c)) for c in keep), pa.ListArray.from_arrays(ends, flat), far], names=[*keep, white, deviation])

    return vectors.mapInArrow(run, schema)


def whiten(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", scale: int = 64, most: int = 16) -> tuple[DataFrame, Whitening | None]:
    """(``df`` without the vector, with ``whitened`` and ``deviation``, and the fit; None for an empty table)."""
    (x,) = fresh_names(df, "x")
    kept = df.withColumn(x, integers(F.col(vector), scale)).where(F.col(x).isNotNull()).drop(vector)
    head = kept.orderBy(F.col(row_id).asc_nulls_last(), F.col(x)).select(F.size(x)).limit(1).collect()
    width = head[0][0] if head else 0
    if not width:
        return kept.drop(x, "whitened", "deviation").withColumns({"whitened": F.lit(None).cast("array<double>"), "deviation": F.lit(None).cast("long")}), None
    fits = kept.withColumn(x, F.when(F.size(x) == width, F.col(x)))
    w = fit(fits.where(F.col(x).isNotNull()), x, width, most)
    return apply(fits, x, w).drop(x), w
