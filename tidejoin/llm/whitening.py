"""Whitening of embeddings by Chebyshev-filtered subspace iteration over distributed passes.

The covariance V is never formed.  A pass multiplies it with a few columns: tasks add up
their rows' part of Xc' (Xc Q), Xc the centred fit list, and Spark sums a row per dimension.
A block of more columns than components are asked for goes through

1. a few Lanczos steps, which bound the spectrum from both sides;
2. rounds of a Chebyshev polynomial of V, small on the unwanted part of the spectrum and
   steep above it, then QR and Rayleigh-Ritz;
3. a certificate: the residual of each wanted pair, |V q - theta q|, is at most
   ``TOLERANCE`` times the largest eigenvalue, and Lanczos steps on what the block leaves
   bound the largest eigenvalue there below the wanted ones.

If the block is as wide as the space, one Rayleigh-Ritz step is exact.

Rows whose vector is null or holds null or non-finite entries are left out.  Vectors of
another length than most rows have (the longer at a tie) and empty vectors are left out too.
Each entry c becomes the long floor(64 c) + 1,000,000; the fit list holds each different
vector once, so repeated rows weigh nothing more, but all get their coordinates.  Components
whose eigenvalue is zero (within rounding) are left out, so constant or few vectors give
fewer; tied eigenvalues give some basis of their space.  A deviation beyond a long is null.
Null ids and repeated ids stay as they are.  Empty tables give no rows.  Of clashing columns
only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Columns of the block beyond the components.
SPARE = 24
#: Steps that bound the spectrum, and degree of the polynomial.
LANCZOS, DEGREE = 8, 12
#: Largest residual of a wanted pair, by the largest eigenvalue; most rounds until it is reached.
TOLERANCE, ROUNDS = 1e-13, 60
#: Bytes of one stored block of the fit list.
BLOCK_BYTES = 1 << 20


def fixed(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: the rows that count, with whole entries."""
    x = F.col("_v")
    good = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.transform(vector, lambda c: c.cast("double")).alias("_v")).where(x.isNotNull() & (F.size(x) > 0)).where(good)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(SCALE * c).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


@dataclass(frozen=True)
class Moments:
    """Number, dimension and exact sums of the different vectors."""

    n: int
    d: int
    sums: tuple[int, ...]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """(n x - S) / n, the numerator exact as long as it fits a long."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums)) < 2**62:
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return x - self.mean


@dataclass(frozen=True)
class FitList:
    """Blocks of different vectors in the shared folder."""

    blocks: DataFrame
    moments: Moments


def fit_list(rows: DataFrame) -> FitList | None:
    """The fit list of ``fixed`` rows, all of one length."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first[0]
    per = max(1, BLOCK_BYTES // (8 * d))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(0), d)
            out = [m[i : i + per] for i in range(0, len(m), per)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([len(o) for o in out], pa.int64()), pa.array([o.astype("<i8").tobytes() for o in out], pa.binary())], ["k", "block"])

    blocks = written(rows.select("x").distinct().mapInArrow(lean(pack), "k long, block binary"), "fit-list", compression="zstd")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            for block in b.column(0):
                part = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d)
                # halves, so that no sum of a block can pass a long
                total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, (part >> 32).sum(0), (part & 0xFFFFFFFF).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], ["i", "s"])

    sums = blocks.select("block").mapInArrow(lean(add), "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return FitList(blocks, Moments(blocks.agg(F.sum("k")).first()[0], d, tuple(int(r.s) for r in sorted(sums))))


Rows = Callable[[np.ndarray], np.ndarray]


def summed(fit: FitList, rows_of: Rows, width: int, height: int) -> np.ndarray:
    """The sum over the fit list of a matrix of ``height`` rows that each block gives, over n.

    A task sends one row per line of the matrix, and Spark adds them up by line: the driver gets the sum alone.
    """

    own = fit.moments

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for b in batches:
            for block in b.column(0):
                total += rows_of(own.centred(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, own.d)))
        yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), *[pa.array(total[:, j]) for j in range(width)]], names)

    names = ["i", *[f"c{j}" for j in range(width)]]
    out = fit.blocks.select("block").mapInArrow(run, "i int, " + ", ".join(f"{n} double" for n in names[1:]))
    out = out.groupBy("i").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()
    return np.array([r[1:] for r in sorted(out)]) / own.n


def product(fit: FitList, q: np.ndarray) -> np.ndarray:
    """V Q in one pass."""
    return summed(fit, lambda x: x.T @ (x @ q), q.shape[1], fit.moments.d)


def lanczos(apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int) -> tuple[float, float]:
    """Estimates of the least eigenvalue and a bound of the largest: Ritz values, and the last residual on top."""
    v, before, beta, a, b = start / np.linalg.norm(start), np.zeros_like(start), 0.0, [], []
    basis = [v]
    for _ in range(steps):
        w = apply(v[:, None])[:, 0] - beta * before
        a.append(float(w @ v))
        w -= a[-1] * v
        for u in basis:
            w -= (w @ u) * u
        beta = float(np.linalg.norm(w))
        if beta <= 1e-12 * max(map(abs, a)) or beta == 0:
            b.append(0.0)
            break
        b.append(beta)
        before, v = v, w / beta
        basis.append(v)
    theta = np.linalg.eigvalsh(np.diag(a) + np.diag(b[:-1], 1) + np.diag(b[:-1], -1))
    return float(theta[0]), float(theta[-1]) + b[-1]


@dataclass(frozen=True)
class Components:
    """Unit eigenvectors (columns), eigenvalues, trace of V, and rounds until certified."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    rounds: int


def leading(fit: FitList, k: int = COMPONENTS, spare: int = SPARE, degree: int = DEGREE, tolerance: float = TOLERANCE) -> Components:
    """The first k eigenpairs of V; raises if they can't be certified."""
    if spare < 1:
        raise ValueError("the block needs more columns than components")
    d, rng = fit.moments.d, np.random.default_rng(7)
    trace = float(summed(fit, lambda x: np.square(x).sum(0)[:, None], 1, d).sum())
    if trace == 0:
        return Components(np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    k, width = min(k, d), min(d, k + spare)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0] if width < d else np.eye(d)
    vq = product(fit, q)
    low = 0.0 if width == d else max(0.0, 0.9 * lanczos(lambda v: product(fit, v), rng.standard_normal(d), LANCZOS)[0])
    for round_ in range(ROUNDS):
        ritz, s = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        ritz, s = ritz[::-1], s[:, ::-1]
        q, vq = q @ s, vq @ s
        residual = np.linalg.norm(vq - q * ritz, axis=0)[:k].max()
        if width == d or (residual <= tolerance * ritz[0] and _nothing_left(fit, q, ritz, k, trace, rng)):
            return Components(_signed(q[:, :k]), ritz[:k], trace, round_)
        high = float(ritz[-1])
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-300 + 1e-12 * high)
        # three-term recurrence of the scaled polynomials; columns are scaled to keep numbers near one
        y0, y1 = q, (vq - centre * q) / half
        for _ in range(degree - 1):
            y0, y1 = y1, 2 * (product(fit, y1) - centre * y1) / half - y0
            size = np.linalg.norm(y1, axis=0)
            size[size == 0] = 1
            y0, y1 = y0 / size, y1 / size
        q = np.linalg.qr(y1)[0]
        vq = product(fit, q)
    raise ArithmeticError(f"the components are not certified after {ROUNDS} rounds: residual {residual:g}")


def _nothing_left(fit: FitList, q: np.ndarray, ritz: np.ndarray, k: int, trace: float, rng: np.random.Generator) -> bool:
    """Whether the largest eigenvalue outside of the block lies below the wanted ones: by the trace, else by Lanczos."""
    if trace - ritz.sum() <= ritz[k - 1]:
        return True
    away = lambda v: v - q @ (q.T @ v)
    steps = min(LANCZOS, fit.moments.d - q.shape[1])
    return lanczos(lambda v: away(product(fit, away(v))), away(rng.standard_normal(fit.moments.d)), steps)[1] <= ritz[k - 1] * (1 + 1e-9)


def _signed(q: np.ndarray) -> np.ndarray:
    """The largest entry of a vector is positive."""
    return q * np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])


def whitened(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component."""
    kind = embeddings.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with scratch(embeddings.sparkSession) as keep:
        rows = fixed(embeddings, vec_id, vector)
        lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        if lengths is None:
            return embeddings.sparkSession.createDataFrame([], schema)
        rows = rows.where(F.size("x") == lengths.d)
        fit = fit_list(rows)
        found = leading(fit, k)
        real = found.values > fit.moments.d * np.finfo(float).eps * found.values.max(initial=0)
        vectors, values = found.vectors[:, real], found.values[real]
        scaled = vectors / np.sqrt(values)
        r = len(values)
        w = summed(fit, lambda x: (y := x @ scaled).T @ y, r, r) if r else np.zeros((0, 0))
        m = summed(fit, lambda x: (x @ scaled).sum(0)[:, None], 1, r)[:, 0] if r else np.zeros(0)
        error = float(np.abs(w - np.outer(m, m) - np.eye(r)).max(initial=0))
    plain, explained = fit.moments, values / found.trace if found.trace else values
    n, sums = plain.n, plain.sums

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = max(1, BLOCK_BYTES // (8 * plain.d))
        for b in batches:
            for i in range(0, b.num_rows if r else 0, per):
                part = b.slice(i, per)
                x = _matrix(part.column(1), plain.d)
                y = plain.centred(x) @ scaled
                rows_, ids = len(x), np.repeat(np.arange(len(x)), r)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(ids)), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * r, n)), deviations(x, n, sums).take(pa.array(ids)), pa.array(y.ravel()), pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * r, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(lean(run), schema)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """Sum of (n x - S)^2 over the dimensions, exact; in whole numbers of any size where longs may not hold it."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most < 2**62:
        e = n * x - np.array(sums, np.int64)
        if len(sums) * float(np.square(np.abs(e).max(initial=0).astype(float))) < 2.0**62:
            return pa.array(np.square(e).sum(1))
    each = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([e if e < 2**63 else None for e in each], pa.int64())
