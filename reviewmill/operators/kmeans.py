"""k-means with many starts and several k over any number of rows.

All starts run on a weighted coreset, a sample drawn in one pass with probabilities that follow each row's share of the
whole scatter and weighed by their inverse, so that its cost for any centers is close to that of all rows. The starts
are spread over tasks. The cheapest centers of every k are then refined on all rows, those of all k in the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill import constants as C
from reviewmill.operators.scale import arrow_vectors, sum_over

#: Expected rows of the coreset; a table with no more rows is its own coreset, with weights of one.
CORESET_ROWS = 16_384
ROWS_PER_TASK = 100_000


@dataclass(frozen=True)
class Centers:
    """centers (k x width) and their cost: the sum of the squared distances of all rows to the nearest one."""

    centers: np.ndarray
    cost: float

    @property
    def k(self) -> int:
        return len(self.centers)

    def label(self, vector: Column | str) -> Column:
        """Number of the nearest center, the lower one on a tie; NULL for a NULL vector."""
        centers = self.centers

        def nearest(column: pa.Array) -> pa.Array:
            present = np.asarray(column.is_valid())
            labels = np.zeros(len(column), dtype=np.int32)
            if present.any():
                labels[present] = nearest_centers(arrow_vectors(column.drop_null()), centers)[0]
            return pa.array(labels, mask=~present)

        return F.arrow_udf(nearest, "int")(vector)


def nearest_centers(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest center of every row."""
    squares = (x * x).sum(axis=1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(axis=1)
    labels = squares.argmin(axis=1)
    return labels, np.maximum(squares[np.arange(len(x)), labels], 0.0)


def sums_by_label(x: np.ndarray, labels: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Weighted sums of the rows of each label, as a matrix product."""
    member = np.zeros((len(x), k))
    member[np.arange(len(x)), labels] = 1.0 if weights is None else weights
    return member.T @ x


def dealt(reduced: DataFrame) -> DataFrame:
    """review_id, reduced in an order that depends on the data alone: rows are dealt by a hash of the id to a number of
    partitions that follows from their number, and sorted there. Sums over them are repeatable under any input
    partitioning."""
    parts = max(1, -(-reduced.count() // ROWS_PER_TASK))
    return reduced.select("review_id", "reduced").repartition(parts, "review_id").sortWithinPartitions("review_id")


# --- coreset ------------------------------------------------------------------------


@dataclass(frozen=True)
class Coreset:
    points: np.ndarray
    weights: np.ndarray
    rows: int
    mean_variance: float


def coreset(rows: DataFrame, size: int = CORESET_ROWS, seed: int = C.SEED) -> Coreset:
    """A weighted sample of about `size` rows: half of the chance is the same for all, half follows the squared distance
    from the mean. Which rows it holds depends on their ids and the seed, not on partitions."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = arrow_vectors(batch.column("reduced"))
        return np.concatenate([[len(x)], x.sum(axis=0)])

    total = sum_over(rows, moments)
    if total is None:
        return Coreset(np.zeros((0, 0)), np.zeros(0), 0, 0.0)
    n, mean = int(total[0]), total[1:] / total[0]

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([((arrow_vectors(batch.column("reduced")) - mean) ** 2).sum()])

    scatter = float(sum_over(rows, squares)[0])
    everything = n <= size

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            share = np.ones(batch.num_rows)
            if not everything:
                gap = ((arrow_vectors(batch.column("reduced")) - mean) ** 2).sum(axis=1)
                share = np.minimum(1.0, size * (0.5 / n + 0.5 * gap / max(scatter, 1e-300)))
            taken = np.flatnonzero(batch.column("chance").to_numpy() < share)
            yield pa.RecordBatch.from_arrays(
                [batch.column("review_id").take(pa.array(taken)), batch.column("reduced").take(pa.array(taken)),
                 pa.array(1.0 / share[taken])], names=["review_id", "reduced", "weight"])

    chance = (F.xxhash64(F.lit(seed), "review_id").bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))).alias("chance")
    schema = f"{_type(rows, 'review_id')}, reduced array<double>, weight double"
    found = rows.select("review_id", F.col("reduced").cast("array<double>").alias("reduced"), chance).mapInArrow(
        draw, schema).toArrow()
    order = np.argsort(found.column("review_id").to_numpy(), kind="stable")
    points = arrow_vectors(found.column("reduced").combine_chunks())[order]
    return Coreset(points, found.column("weight").to_numpy()[order], n, scatter / n / len(mean))


def _type(rows: DataFrame, column: str) -> str:
    return f"{column} {rows.schema[column].dataType.simpleString()}"


# --- starts ---------------------------------------------------------------------------


def _start(points: np.ndarray, weights: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k-means++: each next center is the best of a few points drawn by weight times squared distance to the last ones."""
    chosen = [random.choice(len(points), p=weights / weights.sum())]
    gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(1, k):
        mass = np.cumsum(weights * gap)
        if mass[-1] <= 0:
            chosen.append(int(random.integers(len(points))))
            continue
        drawn = np.searchsorted(mass, random.random(2 + int(np.log(k))) * mass[-1])
        drawn = np.minimum(drawn, len(points) - 1)
        after = np.minimum(gap, ((points[None] - points[drawn][:, None]) ** 2).sum(axis=2))
        best = int(np.argmin(after @ weights))
        chosen.append(int(drawn[best]))
        gap = after[best]
    return points[chosen].astype(np.float64)


def weighted_kmeans(
    points: np.ndarray, weights: np.ndarray, k: int, seed: int, max_iter: int, tolerance: float
) -> tuple[np.ndarray, float]:
    """Centers and weighted cost of one run from a seeded start; stops when the centers moved less than `tolerance`."""
    random = np.random.default_rng(seed)
    centers = _start(points, weights, k, random)
    for _ in range(max_iter):
        labels, gap = nearest_centers(points, centers)
        size = np.bincount(labels, weights, k)
        sums = sums_by_label(points, labels, k, weights)
        moved = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centers)
        for empty in np.flatnonzero(size == 0):  # goes to the point that costs most
            worst = int(np.argmax(weights * gap))
            moved[empty], gap[worst] = points[worst], 0.0
        shift = ((moved - centers) ** 2).sum()
        centers = moved
        if shift <= tolerance:
            break
    return centers, float(nearest_centers(points, centers)[1] @ weights)


def best_starts(
    sample: Coreset, ks: Sequence[int], spark, seed: int, restarts: int, max_iter: int, tolerance: float
) -> list[np.ndarray]:
    """For each k the cheapest centers of `restarts` runs on the coreset. Every run is a row, and Spark spreads them."""
    points, weights = sample.points, sample.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                centers, cost = weighted_kmeans(points, weights, row["k"], row["seed"], max_iter, tolerance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["k"]], pa.int32()), pa.array([row["seed"]], pa.int64()), pa.array([cost]),
                     pa.array([centers.tobytes()], pa.binary())], names=["k", "seed", "cost", "centers"])

    runs = [(k, seed + i) for i in range(restarts) for k in ks]
    table = spark.createDataFrame(runs, "k int, seed bigint").repartition(min(len(runs), 64))
    best = table.mapInArrow(run, "k int, seed bigint, cost double, centers binary").groupBy("k").agg(
        F.min_by("centers", F.struct("cost", "seed")).alias("centers"))
    found = {row["k"]: np.frombuffer(row["centers"]).reshape(row["k"], -1) for row in best.collect()}
    return [found[k] for k in ks]


# --- all rows ---------------------------------------------------------------------------


def refine(rows: DataFrame, starts: list[np.ndarray], max_iter: int, tolerance: float) -> list[Centers]:
    """Lloyd's iterations on all rows for several sets of centers at once, one pass an iteration, until every set moved
    less than the tolerance. The cost is that of the returned centers, from a last pass."""
    centers = [np.array(s) for s in starts]
    open_ = list(range(len(centers)))

    def sums(which: list[int]):
        current = [centers[i] for i in which]

        def part(batch: pa.RecordBatch) -> np.ndarray:
            x = arrow_vectors(batch.column("reduced"))
            out = []
            for own in current:
                labels, gap = nearest_centers(x, own)
                total = np.zeros((len(own), x.shape[1] + 2))
                total[:, :-2] = sums_by_label(x, labels, len(own))
                total[:, -2], total[:, -1] = np.bincount(labels, minlength=len(own)), np.bincount(labels, gap, len(own))
                out.append(total)
            return np.concatenate(out)

        return part

    for _ in range(max_iter):
        if not open_:
            break
        totals = np.split(sum_over(rows, sums(open_)), np.cumsum([len(centers[i]) for i in open_])[:-1])
        still = []
        for i, total in zip(open_, totals):
            size = total[:, -2:-1]
            moved = np.where(size > 0, total[:, :-2] / np.maximum(size, 1), centers[i])
            if ((moved - centers[i]) ** 2).sum() > tolerance:
                still.append(i)
            centers[i] = moved
        open_ = still
    totals = np.split(sum_over(rows, sums(list(range(len(centers))))), np.cumsum([len(c) for c in centers])[:-1])
    return [Centers(c, float(t[:, -1].sum())) for c, t in zip(centers, totals)]


def fit(
    rows: DataFrame, ks: Sequence[int], seed: int = C.SEED, restarts: int = C.KMEANS_RESTARTS,
    max_iter: int = C.KMEANS_MAX_ITER, size: int = CORESET_ROWS,
) -> list[Centers]:
    """Centers for every k over rows (review_id, reduced) that are `dealt` and kept. Centers count as settled when together
    they moved less than a 10^-4 part of the data's mean variance. A k beyond the number of rows is an error."""
    sample = coreset(rows, size, seed)
    if sample.rows < max(ks):
        raise ValueError(f"{sample.rows} rows cannot be split into {max(ks)} clusters")
    tolerance = C.KMEANS_TOLERANCE * max(sample.mean_variance, 1e-300)
    starts = best_starts(sample, ks, rows.sparkSession, seed, restarts, max_iter, tolerance)
    return refine(rows, starts, max_iter, tolerance)
