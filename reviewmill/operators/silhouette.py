"""Silhouettes over all rows.

Euclidean: the distances of a row to all others are summed by cluster, block by block; no pair is kept. Several clusterings are
compared by reference sets instead: a row's mean distance to a cluster is taken over references of the cluster, drawn with a
chance that is half the same for all its members and half follows their distance from the centroid, and weighed by its inverse.
A member x at distance d(x, y) enters with at most 6 times the true mean, so m references give the mean with a relative standard
error of at most sqrt(5 / m), whatever the shape of the cluster; clusters with no more members than references are exact. With
squared distances a cluster's count, sum and sum of squared lengths give the exact mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from reviewmill import constants as C
from reviewmill.llm.scratch import located
from reviewmill.operators.kmeans import Centers, nearest_centers
from reviewmill.operators.scale import arrow_vectors, materialize, pin, sum_over

#: The most clusters whose sums a task holds for its rows.
MAX_CLUSTERS = 1_024
LEAST = 32  # references of a cluster, however many clusters there are
#: Distances that a task holds at once, whatever the number of references.
DISTANCES_AT_ONCE = 1 << 20
#: Rows that a task compares with all others, less where their vectors take more bytes, and rows of a block of the others.
TASK_ROWS, TASK_BYTES, BLOCK_ROWS = 8_192, 1 << 25, 2_048
#: Squared distances below this share of a row's squared length are taken from the differences, where a product would cancel.
NEAR = 1e-8


def squared_silhouette(labelled: DataFrame, vector: str = "embedding") -> float:
    """Mean silhouette of all rows of (cluster_id, vector) with squared Euclidean distance; -1 with fewer than two clusters.
    Rows without a vector take no part."""
    rows = labelled.where(F.col(vector).isNotNull()).select(
        F.col("cluster_id").cast("double").alias("cluster_id"), array_to_vector(vector).alias("features"))
    if rows.select("cluster_id").distinct().limit(2).count() < 2:
        return -1.0
    return ClusteringEvaluator(predictionCol="cluster_id").evaluate(rows)


@dataclass(frozen=True)
class Silhouette:
    """value: mean over all rows. error: bound of the relative standard error of every row's mean distances."""

    value: float
    error: float


@dataclass(frozen=True)
class _Groups:
    """Sizes and centroids of the clusters of one labelling, and their references in the order of the clusters."""

    sizes: np.ndarray
    centroids: np.ndarray
    points: np.ndarray | None = None
    weights: np.ndarray | None = None
    first: np.ndarray | None = None

    @cached_property
    def lengths(self) -> np.ndarray:
        """Squared lengths of the references."""
        return (self.points * self.points).sum(axis=1)


def euclidean_silhouette(
    labelled: DataFrame, vector: str = "embedding", references: int | None = None, seed: int = C.SEED
) -> Silhouette:
    """Mean silhouette of all rows of (review_id, cluster_id, vector) with Euclidean distance; -1 with fewer than two
    clusters. A row alone in its cluster has 0. Rows without a vector take no part. At most MAX_CLUSTERS clusters.

    All distances are computed, so the work grows with the square of the rows; a number of `references` asks for an estimate."""
    rows = labelled.where(F.col(vector).isNotNull()).select(
        "review_id", F.col("cluster_id").alias("cluster_id"), F.col(vector).cast("array<double>").alias("reduced"))
    names = [r[0] for r in pin(rows.select("cluster_id").distinct()).orderBy("cluster_id").limit(MAX_CLUSTERS + 1).collect()]
    if len(names) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters; use the squared silhouette")
    if len(names) < 2:
        return Silhouette(-1.0, 0.0)
    at = F.create_map(*[F.lit(x) for pair in zip(names, range(len(names))) for x in pair])
    numbered = rows.select("review_id", "reduced", at[F.col("cluster_id")].cast("int").alias("label"))

    def labels(batch: pa.RecordBatch, x: np.ndarray) -> list[np.ndarray]:
        return [batch.column("label").to_numpy(zero_copy_only=False)]

    if references is None:
        return Silhouette(_exact(numbered, _groups(numbered, labels, [len(names)])[0]), 0.0)
    return _silhouettes(numbered, labels, [len(names)], references, seed)[0]


def silhouettes(rows: DataFrame, fits: list[Centers], references: int, seed: int = C.SEED) -> list[Silhouette]:
    """Euclidean silhouettes of several k-means results over the same rows (review_id, reduced), in common passes."""
    centers = [fit.centers for fit in fits]

    def labels(batch: pa.RecordBatch, x: np.ndarray) -> list[np.ndarray]:
        return [nearest_centers(x, own)[0] for own in centers]

    return _silhouettes(rows, labels, [len(c) for c in centers], references, seed)


def _exact(rows: DataFrame, group: _Groups) -> float:
    """Mean silhouette of all rows of (reduced, label) from all their distances.

    The rows are written once as matrix blocks, a file a task. A task streams through all files and holds the sums of its
    own rows' distances to each cluster.
    """
    n, width = int(group.sizes.sum()), group.centroids.shape[1]
    centre = group.sizes @ group.centroids / n  # distances from it are no larger than they need be
    centre = np.where(np.isfinite(centre), centre, 0.0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = arrow_vectors(batch.column("reduced")) - centre, batch.column("label").to_numpy()
            for begin in range(0, len(x), BLOCK_ROWS):
                order = begin + np.argsort(own[begin: begin + BLOCK_ROWS], kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[order].tobytes()], pa.binary()), pa.array([own[order].astype(np.int32).tobytes()], pa.binary())],
                    names=["vectors", "labels"])

    spark = rows.sparkSession
    task_rows = min(TASK_ROWS, max(1, TASK_BYTES // (8 * width)))
    parts, cores = -(-n // task_rows), spark.sparkContext.defaultParallelism
    parts = max(parts, min(-(-parts // cores) * cores, -(-n // BLOCK_ROWS)))
    packed = materialize(rows.select("reduced", "label").repartition(parts).mapInArrow(pack, "vectors binary, labels binary"))
    files = sorted(packed.inputFiles())

    def blocks(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        store, path = located(uri)
        with store.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(1):
                for row in batch.to_pylist():
                    yield np.frombuffer(row["vectors"]).reshape(-1, width), np.frombuffer(row["labels"], np.int32)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(1)
        for number in batch.column("id").to_pylist():
            own = [*blocks(files[number])]
            if own:
                x, label = np.concatenate([x for x, _ in own]), np.concatenate([label for _, label in own])
                del own
                sums = _distance_sums(x, (block for uri in files for block in blocks(uri)), len(group.sizes))
                total += _from_means(sums / np.maximum(group.sizes, 1), label, group.sizes).sum()
        return total

    return float(sum_over(spark.range(0, len(files), 1, len(files)), part)[0] / n)


def _distance_sums(x: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], count: int) -> np.ndarray:
    """The sum of every row's distances to each cluster, over blocks of rows in the order of their clusters."""
    lengths = (x * x).sum(axis=1)
    left = np.column_stack([x, lengths, np.ones(len(x))])
    near = NEAR * lengths
    sums = np.zeros((len(x), count))
    for y, label in blocks:
        right = np.vstack([-2 * y.T, np.ones(len(y)), (y * y).sum(axis=1)])
        first = np.flatnonzero(np.diff(label, prepend=-1))
        step = max(1, DISTANCES_AT_ONCE // len(y))
        for begin in range(0, len(x), step):
            distances = left[begin: begin + step] @ right
            close = np.flatnonzero(distances.min(axis=1) < near[begin: begin + step])
            if len(close):
                row, column = np.nonzero(distances[close] < near[begin + close][:, None])
                row = close[row]
                for at in range(0, len(row), len(x)):
                    i, j = row[at: at + len(x)], column[at: at + len(x)]
                    distances[i, j] = ((x[begin + i] - y[j]) ** 2).sum(axis=1)
            np.sqrt(distances, out=distances)
            sums[begin: begin + step, label[first]] += np.add.reduceat(distances, first, axis=1)
    return sums


def _silhouettes(rows: DataFrame, labels, counts: list[int], references: int, seed: int) -> list[Silhouette]:
    groups = _groups(rows, labels, counts)
    groups = _with_references(rows, labels, groups, references, seed)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = arrow_vectors(batch.column("reduced"))
        total = np.zeros((len(groups), 2))
        for i, (own, group) in enumerate(zip(labels(batch, x), groups)):
            step = max(1, DISTANCES_AT_ONCE // max(len(group.points), 1))
            for begin in range(0, len(x), step):
                piece = slice(begin, begin + step)
                total[i] += _scores(x[piece], own[piece], group).sum(), len(x[piece])
        return total

    total = sum_over(rows, part)
    out = []
    for (value, n), group, count in zip(total, groups, counts):
        sampled = group.weights is not None and (group.weights > 1).any()
        share = max(LEAST, references // count)
        single = np.count_nonzero(group.sizes) < 2
        out.append(Silhouette(-1.0 if single else float(value / n), float(np.sqrt(5 / share)) if sampled else 0.0))
    return out


def _groups(rows: DataFrame, labels, counts: list[int]) -> list[_Groups]:
    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = arrow_vectors(batch.column("reduced"))
        out = []
        for own, count in zip(labels(batch, x), counts):
            total = np.zeros((count, x.shape[1] + 1))
            order = np.argsort(own, kind="stable")  # clusters may be many, so no row a cluster for each row
            first = np.flatnonzero(np.diff(own[order], prepend=-1))
            if len(first):
                total[own[order][first], :-1] = np.add.reduceat(x[order], first, axis=0)
            total[:, -1] = np.bincount(own, minlength=count)
            out.append(total)
        return np.concatenate(out)

    totals = np.split(sum_over(rows, part), np.cumsum(counts)[:-1])
    return [_Groups(t[:, -1], t[:, :-1] / np.maximum(t[:, -1:], 1)) for t in totals]


def _with_references(rows: DataFrame, labels, groups: list[_Groups], references: int, seed: int) -> list[_Groups]:
    def spread(batch: pa.RecordBatch) -> np.ndarray:
        x = arrow_vectors(batch.column("reduced"))
        return np.concatenate([
            np.bincount(own, np.linalg.norm(x - g.centroids[own], axis=1), len(g.sizes))
            for own, g in zip(labels(batch, x), groups)])

    spreads = np.split(sum_over(rows, spread), np.cumsum([len(g.sizes) for g in groups])[:-1])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = arrow_vectors(batch.column("reduced"))
            chance = batch.column("chance").to_numpy()
            for number, (own, g, total) in enumerate(zip(labels(batch, x), groups, spreads)):
                wanted = max(LEAST, references // len(g.sizes))
                gap = np.linalg.norm(x - g.centroids[own], axis=1)
                even, size = 0.5 / g.sizes[own], g.sizes[own]
                share = np.where(size <= wanted, 1.0, wanted * (even + 0.5 * gap / np.maximum(total[own], 1e-300)))
                taken = np.flatnonzero(chance < share)
                if len(taken):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(taken), number), pa.int32()), pa.array(own[taken], pa.int32()),
                         batch.column("chance").take(pa.array(taken)), pa.array(1.0 / np.minimum(1.0, share[taken])),
                         batch.column("reduced").take(pa.array(taken))],
                        names=["labelling", "label", "chance", "weight", "reduced"])

    chance = (F.xxhash64(F.lit(seed + 1), "review_id").bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))).alias("chance")
    more = [F.col("label")] if "label" in rows.columns else []
    drawn = rows.select("review_id", F.col("reduced").cast("array<double>").alias("reduced"), chance, *more).mapInArrow(
        draw, "labelling int, label int, chance double, weight double, reduced array<double>").toArrow()
    table = {name: drawn.column(name).to_numpy() for name in ("labelling", "label", "chance", "weight")}
    points = arrow_vectors(drawn.column("reduced").combine_chunks())
    out = []
    for number, g in enumerate(groups):
        own = np.flatnonzero(table["labelling"] == number)
        own = own[np.lexsort((table["chance"][own], table["label"][own]))]
        first = np.searchsorted(table["label"][own], np.arange(len(g.sizes)))
        out.append(_Groups(g.sizes, g.centroids, points[own], table["weight"][own], first))
    return out


def _scores(x: np.ndarray, own: np.ndarray, g: _Groups) -> np.ndarray:
    """Silhouette of every row from its mean distances to the references of each cluster."""
    present = np.flatnonzero(g.sizes)
    distances = x @ (-2 * g.points.T)  # one matrix all along
    distances += (x * x).sum(axis=1)[:, None]
    distances += g.lengths
    np.maximum(distances, 0.0, out=distances)
    np.sqrt(distances, out=distances)
    distances *= g.weights
    weights = np.add.reduceat(g.weights, g.first[present])
    means = np.full((len(x), len(g.sizes)), np.inf)
    means[:, present] = np.add.reduceat(distances, g.first[present], axis=1) / weights
    return _from_means(means, own, g.sizes)


def _from_means(means: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouette of every row from its mean distances to each cluster, itself among the members of its own."""
    row = np.arange(len(means))
    size = sizes[own]
    inside = means[row, own] * size / np.maximum(size - 1, 1)  # the row itself is no neighbour of its own
    means[row, own] = np.inf
    outside = means.min(axis=1)
    larger = np.maximum(inside, outside)
    with np.errstate(invalid="ignore"):
        score = (outside - inside) / larger
    return np.where((size > 1) & np.isfinite(larger) & (larger > 0), score, 0.0)
