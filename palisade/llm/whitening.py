"""Whitening of embeddings by matrix-free block Lanczos (operator 12).

Contract.  ``whiten(vectors)`` returns, for every usable row and every component up to
``COMPONENTS``: ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n`` (distinct vectors),
``deviation`` (sum over dimensions of (n*x - S)^2, exact; null beyond a long), ``whitened``,
``explained`` (share of the trace) and ``identity_error`` (greatest entry of the whitened
covariance less the identity).  Entries c count as ``x = floor(64*c) + 1000000``; the components are
fitted on each distinct x vector once, and every usable row is projected.

Method.  A pass over the distinct vectors computes X'(X B) for the centred vectors and a block B of
columns: each task adds up its own part, the parts are added up in Spark, and the driver gets
dimension x block numbers.  The covariance matrix is never formed.  Blocks are orthogonalised
twice against the whole basis; columns that vanish (breakdown) are replaced by random ones
orthogonal to the basis.  The pass ends when the residuals of the leading Ritz vectors, and the change
of their values by the last block, fall below ``TOLERANCE`` times the greatest value, or the basis spans
the space.  The trace comes from the exact sum of deviations, so shares need no further eigenvalues.

Scale.  Distinct vectors are found by one shuffle with partial aggregation (a vector that a third of all
rows hold is one row of each task) and written once; a pass reads them where they lie.

Edge cases: vectors that are null or empty, hold null or non-finite entries (or entries beyond
``LARGEST``), or have another length than most rows (ties: the longer one) are left out; directions
without variance have no component, so equal vectors, a single one or an empty table give no rows; a
null vec_id stays null; repeated rows are all returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch

#: Components returned, columns of a block, residual against the greatest eigenvalue, least eigenvalue against it.
COMPONENTS, BLOCK, TOLERANCE, LEAST = 16, 16, 1e-13, 1e-10
#: Factor and offset of an entry's whole number; greatest number taken.
FACTOR, OFFSET, LARGEST = 64, 1_000_000, 1 << 40
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Moments:
    """Number of vectors and, by dimension, the sums of y = x - OFFSET and of y^2, exact."""

    n: int
    sums: tuple[int, ...]
    squares: tuple[int, ...]

    @property
    def total_deviation(self) -> int:
        """The sum of all vectors' deviations."""
        return self.n * self.n * sum(self.squares) - self.n * sum(s * s for s in self.sums)

    @property
    def trace(self) -> float:
        return float(self.total_deviation / self.n**3) if self.n else 0.0

    def centred(self, y: np.ndarray) -> np.ndarray:
        """y less its mean; whole parts are subtracted as whole numbers."""
        base = np.array([round(s / self.n) for s in self.sums], np.int64)
        rest = np.array([(s - self.n * int(b)) / self.n for s, b in zip(self.sums, base)])
        return (y - base).astype(float) - rest

    def deviations(self, y: np.ndarray) -> list:
        """Sum over dimensions of (n*y - sum)^2 of each vector, exact; None beyond a long."""
        reach = self.n * int(np.abs(y).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if reach * reach * max(1, len(self.sums)) < 1 << 63:
            z = self.n * y - np.array(self.sums, np.int64)
            return (z * z).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in y.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d) - OFFSET


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that count."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))
    rows = rows.where((F.size("e") > 0) & F.forall("e", lambda c: F.coalesce(F.abs(c * FACTOR) < LARGEST, F.lit(False)) & ~F.isnan(c)))
    rows = rows.select("vec_id", F.transform("e", lambda c: F.floor(c * FACTOR) + OFFSET).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (sizes[0].d if sizes else 0))


def moments(fit: DataFrame, d: int) -> Moments:
    """One pass over the distinct vectors; tasks add up whole numbers."""

    def part(batches):
        n, sums, squares = 0, [0] * d, [0] * d
        for b in batches:
            y = _matrix(b, d)
            if np.abs(y).max(initial=0) >= 1 << 20:
                y = y.astype(object)
            n += len(y)
            sums = [a + int(v) for a, v in zip(sums, y.sum(axis=0))]
            squares = [a + int(v) for a, v in zip(squares, (y * y).sum(axis=0))]
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array([Decimal(v) for v in sums], kind), "q": pa.array([Decimal(v) for v in squares], kind)})

    rows = fit.mapInArrow(part, "i int, n long, s decimal(38,0), q decimal(38,0)")
    got = sorted(rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect())
    return Moments(got[0].n if got else 0, tuple(int(r.s) for r in got), tuple(int(r.q) for r in got))


def product(fit: DataFrame, d: int, task: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``task(vectors)`` (a matrix of fixed shape) over all vectors, added up by row in Spark."""

    def part(batches):
        total = None
        for b in batches:
            if b.num_rows:
                got = task(_matrix(b, d))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array(total.tolist(), pa.list_(pa.float64()))})

    parts = fit.mapInArrow(part, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((1 + max(r.i for r in rows), 1 + max(r.j for r in rows)))
    for r in rows:
        out[r.i, r.j] = r.v
    return out


def orthonormal(block: np.ndarray, basis: np.ndarray, want: int, scale: float, rng: np.random.Generator) -> np.ndarray:
    """``want`` orthonormal columns orthogonal to the basis: the block's, and random ones where it breaks down."""
    new = np.zeros((len(basis), 0))
    while new.shape[1] < want:
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            block = block - new @ (new.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        u = u[:, s > 1e-11 * scale][:, : want - new.shape[1]]
        u = u - basis @ (basis.T @ u)  # what was scaled up with a small column
        new = np.linalg.qr(np.hstack([new, u]))[0]
        block, scale = rng.standard_normal((len(basis), want)), 1.0
    return new


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """The k leading eigenvalues and unit eigenvectors of a symmetric operator on d dimensions, and the passes made."""
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    block, before, passes = min(block, d), None, 0
    q = np.linalg.qr(rng.standard_normal((d, block)))[0]
    while True:
        w = apply(q)
        passes += 1
        basis, images = np.hstack([basis, q]), np.hstack([images, w])
        t = basis.T @ images
        values, rotate = np.linalg.eigh((t + t.T) / 2)
        values, rotate = values[::-1][:k], rotate[:, ::-1][:, :k]
        vectors, top = basis @ rotate, max(abs(values[0]), np.finfo(float).tiny)
        residual = np.linalg.norm(images @ rotate - vectors * values, axis=0).max()
        steady = before is not None and len(before) == len(values) == min(k, d) and np.abs(before - values).max() <= tolerance * top
        if basis.shape[1] >= d or residual <= tolerance * top and steady:
            return values, vectors, passes
        before = values
        q = orthonormal(w, basis, min(block, d - basis.shape[1]), top, rng)


def whiten(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """The whitened components of every usable row; see the module's contract."""
    spark = vectors.sparkSession
    scratch.bound_batches(spark)
    rows = usable(vectors)
    fit = scratch.keep(rows.select("x").distinct(), "fit")
    first = fit.first()
    if first is None:
        return spark.createDataFrame([], RESULT)
    d = len(first.x)
    m = moments(fit, d)

    def covariance(q):
        return product(fit, d, lambda y: (c := m.centred(y)).T @ (c @ q)) / m.n

    values, axes, _ = block_lanczos(covariance, d, components, block)
    keep = values > LEAST * max(values[0], 0) if m.total_deviation else np.zeros(len(values), bool)
    values, axes = values[keep], axes[:, keep]
    k = len(values)
    if not k:
        return spark.createDataFrame([], RESULT)
    scaled = axes / np.sqrt(values)

    def second(y):
        z = m.centred(y) @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)])

    got = product(fit, d, second)
    mean = got[k] / m.n
    error = float(np.abs(got[:k] / m.n - np.outer(mean, mean) - np.eye(k)).max())
    shares = values / m.trace

    def project(batches):
        for b in batches:
            if b.num_rows:
                y, size = _matrix(b, d), b.num_rows * k
                ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(b.num_rows), k)))
                deviation = pa.array(m.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(b.num_rows), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(size, m.n)), deviation, pa.array((m.centred(y) @ scaled).ravel()), pa.array(np.tile(shares, b.num_rows)), pa.array(np.full(size, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, RESULT)
