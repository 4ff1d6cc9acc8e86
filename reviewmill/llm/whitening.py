"""Whitening of vectors by their leading principal components, for any number of rows.

The components come from subspace iteration: the covariance is only ever multiplied with a thin block of vectors, one
distributed pass over the centred rows each time. Between two orthonormalisations a Chebyshev polynomial of the covariance
is applied, as a three-term recurrence of such passes; it stays small on the unwanted part of the spectrum and grows fast
above it. Rayleigh-Ritz then gives eigenvalues, vectors and residuals, until the residuals certify the wanted ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.llm.scratch import discard, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows packed into one block, vectors kept beside the wanted ones, degree of the polynomial.
BLOCK_ROWS, GUARD, DEGREE = 2048, 16, 8
#: A component counts as found when its residual, over the gap to the next eigenvalue, is below this.
CERTIFIED = 1e-12
MAX_ROUNDS = 60
FAN_IN = 64


@dataclass
class Whitening:
    """n distinct vectors of sums S; components (width x k), eigenvalues and trace of their covariance; residuals of the
    components; largest entry by which the whitened covariance differs from the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float


# --- rows and blocks ----------------------------------------------------------------------


def scaled(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * entry) + shift of every entry, as longs; null for a vector that is null, empty or holds null, NaN or
    an infinite entry."""
    infinite = F.lit(float("inf"))
    entries = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < infinite), F.lit(False)))
    longs = F.transform(entries, lambda c: F.floor(F.lit(float(scale)) * c).cast("bigint") + F.lit(shift))
    return F.when(whole & (F.size(vector) > 0), longs)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one width as little-endian longs, many rows in one block."""
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK_ROWS):
            rows = batch.column("x").slice(begin, BLOCK_ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(rows)], pa.int64()), pa.array([_matrix(rows).astype("<i8").tobytes()], pa.binary())],
                names=["n", "rows"],
            )


def _total(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int, dtype: str = "<f8") -> np.ndarray:
    """Sum of `part(rows)` over all blocks. Every task adds up its own, sums of many tasks are added up in tasks again, and
    at most FAN_IN matrices of fixed size come to the driver."""

    def add(values: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for value in values:
            total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, dtype).tobytes()], pa.binary())], names=["total"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(
            part(np.frombuffer(rows, "<i8").reshape(-1, width))
            for batch in batches for rows in batch.column("rows").to_pylist()
        )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(np.frombuffer(t, dtype) for batch in batches for t in batch.column("total").to_pylist())

    totals = blocks.select("rows").mapInArrow(own, "total binary")
    if blocks.rdd.getNumPartitions() > FAN_IN:
        totals = totals.repartition(FAN_IN).mapInArrow(merged, "total binary")
    found = [np.frombuffer(r["total"], dtype) for r in totals.collect()]
    return np.sum(sorted(found, key=bytes), axis=0)


# --- components -----------------------------------------------------------------------------


def fit(
    vectors: DataFrame, x: str = "x", components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, seed: int = 7
) -> Whitening:
    """Leading components of the distinct vectors (arrays of longs of one width) in column `x`; null ones take no part.

    No component is given for a direction without variance, so a single distinct vector or an empty table has none.
    Raises ArithmeticError if the components are not certified after MAX_ROUNDS rounds.
    """
    distinct = vectors.where(F.col(x).isNotNull()).select(F.col(x).alias("x")).distinct()
    blocks = stored(distinct.mapInArrow(_pack, "n bigint, rows binary"), "whitening-blocks")
    try:
        return _fit(blocks, components, guard, degree, seed)
    finally:
        discard(blocks)


def _fit(blocks: DataFrame, components: int, guard: int, degree: int, seed: int) -> Whitening:
    n, size = blocks.agg(F.sum("n"), F.sum(F.length("rows"))).first()
    if not n:
        none = np.zeros(0)
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), none, 0.0, none, 0.0)
    width = size // (8 * n)
    sums = _total(blocks, lambda rows: rows.sum(axis=0), width, "<i8")
    # the mean as whole number and rest: differences of rows and whole number are exact
    whole = np.array([int(s) // n for s in sums], dtype=np.int64)
    rest = np.array([(int(s) % n) / n for s in sums])

    def centred(rows: np.ndarray) -> np.ndarray:
        return (rows - whole).astype(np.float64) - rest

    def times(block: np.ndarray) -> np.ndarray:
        """Covariance times a block of vectors: one pass."""
        def part(rows: np.ndarray) -> np.ndarray:
            own = centred(rows)
            return own.T @ (own @ block)

        return _total(blocks, part, width).reshape(block.shape) / n

    trace = float(_total(blocks, lambda rows: np.array([(centred(rows) ** 2).sum()]), width)[0]) / n
    wanted = min(components, width, n - 1)
    if trace <= 0.0 or wanted < 1:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), max(trace, 0.0), np.zeros(0), 0.0)
    vectors, values, residuals = _leading(times, width, wanted, guard, degree, seed, trace)
    real = values > 1e-13 * trace
    vectors, values, residuals = vectors[:, real], values[real], residuals[real]
    scaled_vectors = vectors / np.sqrt(values)

    def second(rows: np.ndarray) -> np.ndarray:
        white = centred(rows) @ scaled_vectors
        return np.vstack([white.T @ white, white.sum(axis=0)])

    moments = _total(blocks, second, width).reshape(-1, len(values)) / n
    covariance = moments[:-1] - np.outer(moments[-1], moments[-1])
    error = float(np.abs(covariance - np.eye(len(values))).max()) if len(values) else 0.0
    return Whitening(n, sums, vectors, values, trace, residuals, error)


def _leading(
    times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, guard: int, degree: int, seed: int, trace: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvectors, eigenvalues and residuals of the `wanted` largest eigenvalues, from products with the matrix alone.

    Each round a fresh random vector joins the block before it is filtered, so that a direction the start had missed would
    come up and change the result before it is accepted.
    """
    random = np.random.default_rng(seed)
    size = min(width, wanted + guard)
    basis = np.linalg.qr(random.normal(size=(width, size)))[0]
    image = times(basis)
    floor = 4 * np.finfo(float).eps * trace
    best = np.inf
    stalled = 0
    for _ in range(MAX_ROUNDS):
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        falling = np.argsort(-values)
        values, turn = values[falling], turn[:, falling]
        basis, image = basis @ turn, image @ turn
        residuals = np.linalg.norm(image - basis * values, axis=0)
        gaps = np.full(size, np.inf)
        gaps[:-1] = values[:-1] - values[1:]
        gaps[1:] = np.minimum(gaps[1:], gaps[:-1])
        errors = residuals / np.maximum(gaps, 64 * floor)
        open_ = (errors > CERTIFIED) & (residuals > floor)
        stalled = stalled + 1 if residuals[:wanted].max() > best / 2 else 0
        best = min(best, residuals[:wanted].max())
        # rounding in the sums is the last limit: residuals that stay where they are count if they are that small
        if size == width or not open_[:wanted].any() or (stalled >= 3 and best < 1e3 * floor):
            return basis[:, :wanted], values[:wanted], residuals[:wanted]
        probe = random.normal(size=(width, 1))
        probe -= basis @ (basis.T @ probe)
        block = np.hstack([basis, probe / np.linalg.norm(probe)])
        block = _filtered(times, block, max(values[-1], floor), values[0], degree)
        basis = np.linalg.qr(block)[0]
        image = times(basis)
        if basis.shape[1] > size:  # the fresh vector stays only as far as it belongs to the leading ones
            values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
            basis, image = basis @ turn[:, ::-1][:, :size], image @ turn[:, ::-1][:, :size]
    raise ArithmeticError(f"components not certified after {MAX_ROUNDS} rounds; largest residual {best:g}")


def _filtered(
    times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, unwanted: float, largest: float, degree: int
) -> np.ndarray:
    """The Chebyshev polynomial of the matrix for [0, unwanted], scaled to 1 at `largest`, times the block."""
    half = unwanted / 2
    sigma = first = half / max(largest - half, half)
    before, now = block, (times(block) - half * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


# --- the operator ---------------------------------------------------------------------------


def whiten(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE, shift: int = SHIFT,
) -> tuple[DataFrame, Whitening]:
    """key, deviation and whitened (one entry a component) of every row, and the model.

    Vectors become longs by `scaled`; rows whose vector is null, empty or holds null or non-finite entries are left out, and so
    are those of another width than the most frequent one (the larger on a tie). The model is fitted on each distinct vector
    once. deviation is the exact sum of (n * x - S)^2, null where it is beyond a long. Repeated rows give a row each, rows
    without a key too; other columns, whatever their names, are left out; an empty table gives no rows.
    """
    longs = rows.select(F.col(key).alias("key"), scaled(F.col(vector), scale, shift).alias("x")).where("x IS NOT NULL")
    widths = longs.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("rows"))
    first = widths.orderBy(F.desc("rows"), F.desc("width")).first()
    longs = longs.where(F.size("x") == (first["width"] if first else 0))
    model = fit(longs, "x", components)
    kind = rows.schema[key].dataType
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])
    return longs.mapInArrow(_projection(model), schema), model


def _projection(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n, sums = model.n, model.sums
    axes = model.components / np.sqrt(model.eigenvalues)
    whole = np.array([int(s) // n for s in sums], dtype=np.int64) if n else sums
    rest = np.array([(int(s) % n) / n for s in sums]) if n else np.zeros(0)

    def deviations(x: np.ndarray) -> pa.Array:
        far = ((x.astype(np.float64) * n - sums) ** 2).sum(axis=1)
        if far.max(initial=0.0) < 2.0**62 and np.abs(x).max(initial=0) * float(n) < 2.0**62:
            return pa.array(((x * n - sums) ** 2).sum(axis=1), pa.int64())
        exact = [sum((int(v) * n - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
        return pa.array([d if d < 2**63 else None for d in exact], pa.int64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            white = ((x - whole).astype(np.float64) - rest) @ axes
            offsets = pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), deviations(x), pa.ListArray.from_arrays(offsets, pa.array(white.ravel(), pa.float64()))],
                names=["key", "deviation", "whitened"],
            )

    return project
