"""Embedding whitening: principal components by block Jacobi-Davidson with distributed matrix-free covariance products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Largest entry that is exact as a long after scaling.
LARGEST = float(1 << 40)
#: Bytes of the rows that a task multiplies at a time, and MINRES steps of one correction.
BLOCK_BYTES, INNER = 8 << 20, 6
#: A residual of this many units of rounding times the largest eigenvalue is one of double precision.
ROUNDINGS, OUTER = 64, 60

_EPS = np.finfo(np.float64).eps
Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the orthonormal ``basis``: projected twice, dependent directions left out."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-8]
    return new


def _corrections(product: Product, theta: np.ndarray, locked: np.ndarray, residual: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (1 - XX')(V - theta)(1 - XX') t = -r, t orthogonal to X, for a column of ``residual`` each.

    MINRES on all columns in step, so each step is one distributed product. X, the columns of ``locked``, holds all
    current Ritz vectors.
    """
    away = lambda y: y - locked @ (locked.T @ y)
    b = -away(residual)
    beta = np.linalg.norm(b, axis=0)
    safe = lambda x: np.where(x == 0, 1.0, x)
    live = beta > 0
    v_old, v = np.zeros_like(b), b / safe(beta)
    t, w_old, w = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, beta_now = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        y = away(product(v)) - v * theta
        alpha = np.sum(v * y, axis=0)
        y = away(y - v * alpha - v_old * beta_now)
        beta_next = np.linalg.norm(y, axis=0)
        delta = c * alpha - c_old * s * beta_now
        rho1 = np.hypot(delta, beta_next)
        rho2 = s * alpha + c_old * c * beta_now
        rho3 = s_old * beta_now
        live = live & (rho1 > 0)
        c_old, s_old = c, s
        c, s = delta / safe(rho1), beta_next / safe(rho1)
        w_new = (v - w_old * rho3 - w * rho2) / safe(rho1)
        t = t + np.where(live, c * eta, 0.0) * w_new
        w_old, w = w, w_new
        eta = -s * eta
        v_old, v = v, y / safe(beta_next)
        beta_now = beta_next
        live = live & (beta_next > 0)
        if not live.any():
            break
    return t


def leading_eigenpairs(product: Product, size: int, wanted: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of a symmetric positive operator known by its products with blocks of vectors.

    Jacobi-Davidson: Rayleigh-Ritz in a growing subspace; a Ritz pair whose residual is of double precision is locked, and
    the others are corrected, all together. The subspace starts again from the best Ritz vectors when it is large. Ends
    when all pairs are locked, or when residuals near rounding get no smaller.
    """
    wanted = min(wanted, size)
    q = _orthonormal(np.random.default_rng(seed).normal(size=(size, min(size, wanted + 4))), np.zeros((size, 0)))
    vq = product(q)
    before = np.inf
    for _ in range(OUTER):
        h = q.T @ vq
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, vectors = values[order], vectors[:, order]
        theta, x, vx = values[:wanted], q @ vectors[:, :wanted], vq @ vectors[:, :wanted]
        residual = vx - x * theta
        worst = np.linalg.norm(residual, axis=0)
        scale = max(abs(values[0]), np.finfo(np.float64).tiny)
        todo = worst > ROUNDINGS * _EPS * scale
        if not todo.any() or q.shape[1] == size or (worst.max() < 1e-12 * scale and worst.max() > before / 2):
            return theta, x / np.linalg.norm(x, axis=0)
        before = worst.max()
        if q.shape[1] > max(8 * wanted, 96):
            keep = vectors[:, : 3 * wanted]
            q, vq = q @ keep, vq @ keep
        new = _orthonormal(_corrections(product, theta[todo], x, residual[:, todo], INNER), q)
        if new.shape[1] == 0:  # corrections that the subspace holds already
            new = _orthonormal(residual[:, todo], q)
        if new.shape[1] == 0:
            return theta, x / np.linalg.norm(x, axis=0)
        q, vq = np.hstack([q, new]), np.hstack([vq, product(new)])
    raise RuntimeError(f"residuals of {worst.max():.1e} after {OUTER} rounds")


class _FitList:
    """The distinct scaled vectors, in blocks of a matrix each; its sums and products run on the cluster."""

    def __init__(self, x: DataFrame):
        """``x(x array<long>)`` of one length."""
        distinct = materialize(x.distinct())
        per_dim = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("i").collect()  # two numbers per dimension
        self.n = n = per_dim[0]["n"] if per_dim else 0
        self.size = size = len(per_dim)
        self.sums = sums = np.array([r["s"] for r in per_dim], dtype=np.int64)
        if not n:
            return
        rows = max(1, BLOCK_BYTES // (8 * size))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.column(0).slice(at, rows).flatten().to_numpy().reshape(-1, size)
                    yield pa.RecordBatch.from_arrays([pa.array([centred(part, n, sums).tobytes()], pa.binary())], names=["block"])

        blocks = distinct.coalesce(max(1, -(-n // rows))).mapInArrow(pack, "block binary")
        self.blocks = materialize(blocks)

    def reduce(self, of_block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum of ``of_block`` over all blocks, a matrix of ``shape``; tasks add up their blocks, the cluster the tasks' rows."""
        size = self.size

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for block in batch.column(0):
                    total += of_block(np.frombuffer(block.as_buffer(), dtype=np.float64).reshape(-1, size))
            i, j = np.indices(shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

        found = self.blocks.mapInArrow(sums, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(shape)
        out[found["i"], found["j"]] = found["v"]
        return out

    def product(self, u: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors, without the covariance."""
        return self.reduce(lambda c: c.T @ (c @ u), u.shape) / self.n

    def trace(self) -> float:
        return float(self.reduce(lambda c: np.array([[np.square(c).sum()]]), (1, 1))[0, 0]) / self.n

    def identity_error(self, axes: np.ndarray) -> float:
        """The largest absolute entry of the covariance of the rows projected on ``axes``, less the identity."""
        m = axes.shape[1]
        mean = self.reduce(lambda c: (c @ axes).sum(axis=0)[None, :], (1, m)) / self.n

        def square(c: np.ndarray) -> np.ndarray:
            z = c @ axes - mean
            return z.T @ z

        return float(np.abs(self.reduce(square, (m, m)) / self.n - np.eye(m)).max())


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums/n in doubles, from whole numbers, so that nothing cancels."""
    return (x * n - sums) / n


def _scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    vector = F.col(vector_col)
    sound = F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    checked = lambda c: F.when(F.abs(c) <= LARGEST, F.floor(c.cast("double") * SCALE) + SHIFT).otherwise(F.raise_error(F.lit(f"an entry of a vector is larger than {LARGEST:.0f}")).cast("long"))
    rows = vectors.where(sound & (F.size(vector) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, checked).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


_WHITE = "vec_id long, n long, deviation long, whitened array<double>"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, whitened, eigenvalues, explained, identity_error) of each vector that is whole.

    Entries become x = floor(64 c) + 1,000,000. The fit list holds each distinct x once: n of them, with sums S by
    dimension. ``whitened`` is x - S/n on the unit eigenvectors of the fit list's covariance, by falling eigenvalue, each
    over the root of its eigenvalue; ``deviation`` the exact sum of (n x - S)^2 over dimensions; ``explained`` the
    eigenvalues' shares of the trace.

    Vectors that are null or hold null or non-finite entries give no row, nor do those of another length than most have
    (of several the longest), or of none. Zero vectors and repeated rows take part; a null id gives a row. There are as many
    components as dimensions at most. A component without variance (one distinct vector, or fewer vectors than
    components) has null ``whitened`` values and does not count in ``identity_error``, which is 0 if all are so. Entries
    over 2^40 and deviations over 63 bits raise an error. No rows give no rows.
    """
    rows = _scaled(vectors, id_col, vector_col)
    fit = _FitList(rows.select("x"))
    n, size = fit.n, fit.size
    out = f"{_WHITE}, eigenvalues array<double>, explained array<double>, identity_error double"
    if not n:
        return vectors.sparkSession.createDataFrame([], out)
    trace = fit.trace()
    values, axes = leading_eigenpairs(fit.product, size, components)
    varies = values > 1e-13 * trace if trace > 0 else np.zeros(len(values), dtype=bool)
    axes = np.where(varies, axes / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    error = fit.identity_error(axes[:, varies]) if varies.any() else 0.0
    sums, numbers = fit.sums, lambda v: F.array(*[F.lit(float(x)) for x in v])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(-1, size)
            apart = x * n - sums
            if np.abs(apart).max().astype(np.float64) ** 2 * size >= 2.0**63 or np.abs(x).max().astype(np.float64) * n >= 2.0**62:
                raise OverflowError("the deviation of a vector has more than 63 bits")
            z = pa.array(((apart / n) @ axes).ravel(), mask=np.tile(~varies, len(x)))
            white = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(values), z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), n)), pa.array(np.square(apart).sum(axis=1)), white], names=["vec_id", "n", "deviation", "whitened"])

    white = rows.mapInArrow(project, _WHITE)
    shares = np.where(varies, values, 0.0) / trace if trace > 0 else np.zeros(len(values))
    return white.withColumns({"eigenvalues": numbers(values), "explained": numbers(shares), "identity_error": F.lit(error)})
