"""Embedding whitening: the leading principal components of quantised vectors, and
each vector in their coordinates with unit variance.

The covariance V is never formed for the decomposition. A pass over the corpus
multiplies a thin block Q of d x k numbers by V: every block of vectors gives
XᵀXQ of its centred rows, and the partial products are summed by Spark per entry.
Chebyshev-filtered subspace iteration uses such passes alone: the three-term
recurrence of a Chebyshev polynomial that is small on the unwanted part of the
spectrum damps that part, then QR and a Rayleigh-Ritz step give the components,
until their residuals certify them. The product of the Rayleigh-Ritz step is the
first of the next polynomial, so an iteration of degree m costs m passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged

KINDS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


@dataclass(frozen=True)
class Settings:
    components: int = 4
    scale: float = 256.0
    extra: int = 28  # columns of the block beyond the components
    degree: int = 8  # of the polynomial; passes per iteration
    bound_steps: int = 8  # Lanczos passes that bound the spectrum
    tolerance: float = 1e-15  # of a residual, relative to the largest eigenvalue; or as far as rounding lets it fall
    iterations: int = 60
    block: int = 4096  # vectors packed into one row


# --- vectors ------------------------------------------------------------------------


def quantised(array: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for the vectors of each length: those without nulls and non-finite
    entries, as floor(scale * c). Entries beyond 64 bits count as non-finite."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    there = np.flatnonzero(np.asarray(array.is_valid()))
    sizes = np.asarray(array.value_lengths().fill_null(0))[there]
    flat = array.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        values = flat[(ends[rows] - size)[:, None] + np.arange(size)]
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(values * scale)
            fine = (np.abs(x) < 2.0**63).all(axis=1)
        yield there[rows[fine]], x[fine].astype(np.int64)


def encoded(x: np.ndarray) -> list[bytes]:
    """Each vector as bytes of the narrowest integers that hold it; equal vectors give
    equal bytes."""
    if not x.shape[1]:
        return [b""] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    out = np.empty(len(x), object)
    free = np.ones(len(x), bool)
    for k, kind in enumerate(KINDS):
        info = np.iinfo(kind)
        rows = np.flatnonzero(free & (low >= info.min) & (high <= info.max))
        free[rows] = False
        raw = np.ascontiguousarray(x[rows].astype(kind))
        step = raw.shape[1] * kind.itemsize
        data = raw.tobytes()
        out[rows] = [bytes([k]) + data[i * step : (i + 1) * step] for i in range(len(rows))]
    return out.tolist()


def fit_list(vectors: DataFrame, s: Settings) -> DataFrame:
    """(dims, code): each different x of ``vectors`` (embedding) once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in quantised(batch.column(0), s.scale):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(encoded(x), pa.binary())], ["dims", "code"]
                )

    return vectors.mapInArrow(run, "dims int, code binary").distinct()


def packed(fit: DataFrame, dims: int, s: Settings) -> DataFrame:
    """(kind, data): the vectors of ``fit`` with so many dimensions, many in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[] for _ in KINDS]

        def row(k: int) -> pa.RecordBatch:
            data = b"".join(held[k])
            held[k] = []
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["kind", "data"])

        for batch in batches:
            for code in batch.column(0).to_pylist():
                k = code[0]
                held[k].append(code[1:])
                if len(held[k]) >= s.block:
                    yield row(k)
        for k, some in enumerate(held):
            if some:
                yield row(k)

    return fit.filter(F.col("dims") == dims).select("code").mapInArrow(run, "kind int, data binary")


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield np.frombuffer(data, KINDS[kind]).reshape(-1, dims)


# --- sums over the fit list ---------------------------------------------------------


def summed(table: DataFrame, dims: int, shape: tuple[int, ...], each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``each`` block's array: added up in each task, then by Spark per entry."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in blocks(batches, dims):
            total += each(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["part"])

    entries = table.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "v"))
    out = np.zeros(size)
    for r in entries.groupBy("at").agg(F.sum("v").alias("v")).collect():  # one row per entry of the block
        out[r["at"]] = r["v"]
    return out.reshape(shape)


LIMB, LIMBS = 10**15, 5  # an exact sum travels as five parts of fifteen digits


def moments(table: DataFrame, dims: int) -> tuple[int, list[int], list[int]]:
    """Number of vectors, and the exact sums of x and x² per dimension."""

    def limbs(v: int) -> list[int]:
        out = []
        for _ in range(LIMBS - 1):
            v, low = divmod(v, LIMB)
            out.append(low)
        return [*out, v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (1 + 2 * dims)
        for x in blocks(batches, dims):
            wide = x.astype(np.int64) if np.abs(x.astype(float)).max(initial=0) < 2**24 else x.astype(object)
            sums = [len(x), *wide.sum(axis=0).tolist(), *(wide * wide).sum(axis=0).tolist()]
            total = [a + b for a, b in zip(total, sums, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[p for v in total for p in limbs(v)]], pa.list_(pa.int64()))], ["part"])

    entries = table.mapInArrow(run, "part array<long>").select(F.posexplode("part").alias("at", "v"))
    rows = entries.groupBy("at").agg(F.sum(F.col("v").cast("decimal(28, 0)")).alias("v")).collect()  # one row per part of a sum
    found = [0] * (1 + 2 * dims)
    for r in rows:
        found[r["at"] // LIMBS] += int(r["v"]) * LIMB ** (r["at"] % LIMBS)
    return found[0], found[1 : dims + 1], found[dims + 1 :]


# --- the decomposition --------------------------------------------------------------


def spectrum_bounds(multiply: Callable[[np.ndarray], np.ndarray], dims: int, steps: int, rng: np.random.Generator) -> tuple[float, float]:
    """Bounds of the eigenvalues, from a few Lanczos steps and their last residual."""
    q = rng.standard_normal(dims)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dims)):
        w = multiply(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):
            w -= np.array(basis).T @ (np.array(basis) @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(abs(alpha[0]), 1e-300):
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    values = np.linalg.eigvalsh(t)
    return max(0.0, float(values[0]) - beta[len(alpha) - 1]), float(values[-1]) + beta[len(alpha) - 1]


def leading(multiply: Callable[[np.ndarray], np.ndarray], dims: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the leading eigenpairs of a positive semidefinite matrix that
    is known by its product with a block alone.

    A component is certified when its residual is ``tolerance`` of the largest
    eigenvalue at most, or no longer falls: then rounding of the sums is its bound.
    """
    rng = np.random.default_rng(12)
    k = min(s.components, dims)
    width = min(dims, k + s.extra)
    low, _ = spectrum_bounds(multiply, dims, s.bound_steps, rng)
    q = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    best, stalled = np.inf, 0
    for _ in range(s.iterations):
        vq = multiply(q)
        h = q.T @ vq
        values, z = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, z = values[order], z[:, order]
        q, vq = q @ z, vq @ z
        residual = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max()
        stalled = stalled + 1 if residual > 0.5 * best else 0
        best = min(best, residual)
        if residual <= s.tolerance * max(values[0], 0) or stalled >= 2 or width == dims:
            break
        # T_m of the unwanted interval mapped to [-1, 1]: large above it, at most one inside
        high = max(float(values[-1]), low)
        middle, half = (high + low) / 2, max((high - low) / 2, 1e-3 * values[0])
        before, now = q, (vq - middle * q) / half
        for _ in range(s.degree - 1):
            before, now = now, 2 * (multiply(now) - middle * now) / half - before
            # the recurrence is linear: both terms of a column are scaled alike to unit size
            norm = np.linalg.norm(now, axis=0)
            before, now = before / norm, now / norm
        q = np.linalg.qr(now)[0]
    return values[:k], q[:, :k]


@dataclass(frozen=True)
class Model:
    """What ``whitened`` needs: the size of the fit list and its exact sums, the
    components with their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    scale: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(v, self.n)) for v in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, s: Settings = Settings(), column: str = "embedding") -> Model | None:
    """A model from each different x once; None where no vector remains.

    Vectors have the commonest length of the different x (the longest of several);
    others are not fitted. Components whose eigenvalue is zero, up to rounding, are
    left out, as their scale is not defined.
    """
    prepare(vectors.sparkSession)
    different = staged(fit_list(vectors.select(F.col(column).alias("embedding")), s), "fit-list")
    lengths = different.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None or not lengths["dims"]:
        return None
    dims = lengths["dims"]
    table = staged(packed(different, dims, s), "fit-blocks")
    n, sums, squares = moments(table, dims)
    mean = np.array([float(Fraction(v, n)) for v in sums])
    trace = float(sum(Fraction(b, n) - Fraction(a, n) ** 2 for a, b in zip(sums, squares, strict=True)))

    def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ (centred @ q)

    def multiply(q: np.ndarray) -> np.ndarray:
        return summed(table, dims, q.shape, partial(product, q)) / n

    if trace > 0:
        values, found = leading(multiply, dims, s)
        real = values > 1e-12 * trace
        values, found = values[real], found[:, real]
    else:
        values, found = np.zeros(0), np.zeros((dims, 0))
    model = Model(n, sums, values, found, trace, 0.0, s.scale)
    if not len(values):
        return model
    projection = model.projection

    def covariance(x: np.ndarray) -> np.ndarray:
        w = np.concatenate([np.ones((len(x), 1)), (x - mean) @ projection], axis=1)
        return w.T @ w

    c = summed(table, dims, (len(values) + 1,) * 2, covariance) / n
    error = np.abs(c[1:, 1:] - np.outer(c[0, 1:], c[0, 1:]) - np.eye(len(values))).max()
    return Model(n, sums, values, found, trace, float(error), s.scale)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)², exact; None where it passes 64 bits."""
    bound = n * int(max(-x.min(initial=0), x.max(initial=0))) + max(map(abs, sums), default=0)
    if bound * bound * max(1, len(sums)) < 2**63:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * v - t) ** 2 for v, t in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whitened(vectors: DataFrame, model: Model | None, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per vector and component: (id, component, n, deviation, whitened, explained,
    identity_error).

    Vectors that are null or hold null or non-finite entries, entries whose x passes 64
    bits, or another length than the model's have no rows; nor has any without a
    model. A deviation beyond 64 bits is null. Repeated rows and ids stay repeated;
    other columns are not read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0 if model is None else len(model.values)
        if not k:
            return
        mean, projection = model.mean, model.projection
        explained = model.values / model.trace
        for batch in batches:
            for rows, x in quantised(batch.column(1), model.scale):
                if x.shape[1] != len(mean) or not len(x):
                    continue
                at = np.repeat(rows, k)
                deviation = np.repeat(np.array(deviations(x, model.n, model.sums), object), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(at), model.n, np.int64)), pa.array(deviation.tolist(), pa.int64()),
                        pa.array(((x - mean) @ projection).ravel()), pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(at), model.identity_error)),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(id_col, column).mapInArrow(run, schema)
