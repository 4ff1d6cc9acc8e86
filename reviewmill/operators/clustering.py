"""Clustering: PCA, k-means with restarts, k chosen by silhouette, small-cluster merging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill import constants as C
from reviewmill.operators import kmeans
from reviewmill.operators.scale import materialize, pin
from reviewmill.operators.silhouette import euclidean_silhouette, silhouettes
from reviewmill.operators.selection import representatives

#: References of all clusters together when the silhouettes of several k are compared.
SEARCH_REFERENCES = 4_096


def fit_pca(vectors: DataFrame, dim: int = C.PCA_DIM) -> PCAModel:
    """Model from embedding to reduced, with min(dim, rows - 1, width) components."""
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    k = max(1, min(dim, n - 1, width))
    return PCA(k=k, inputCol="_dense", outputCol="_reduced").fit(_dense(vectors))


def _dense(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("_dense", array_to_vector("embedding"))


def project(model: PCAModel, vectors: DataFrame) -> DataFrame:
    """review_id, reduced (array<double>). The projection is not centred: a common shift changes
    neither distances nor clusters."""
    return model.transform(_dense(vectors.select("review_id", "embedding"))).select(
        "review_id", vector_to_array("_reduced").alias("reduced")
    )


def pca_projection(vectors: DataFrame, dim: int = C.PCA_DIM) -> DataFrame:
    return project(fit_pca(vectors, dim), vectors)


def kmeans_assign(
    reduced: DataFrame,
    k: int,
    seed: int = C.SEED,
    restarts: int = C.KMEANS_RESTARTS,
    max_iter: int = C.KMEANS_MAX_ITER,
) -> DataFrame:
    """review_id, cluster_id; clusters are numbered by their smallest review_id."""
    rows = kmeans.dealt(reduced).persist()
    try:
        model = kmeans.fit(rows, [k], seed, restarts, max_iter)[0]
        labelled = materialize(rows.select("review_id", model.label("reduced").alias("cluster_id")))
    finally:
        rows.unpersist()
    return labelled.withColumn("cluster_id", _numbering(labelled)[F.col("cluster_id")])


def _numbering(labelled: DataFrame, min_size: int = 0) -> Column:
    """Map from k-means label to cluster number: by smallest review_id, small ones to "other"."""
    found = labelled.groupBy("cluster_id").agg(
        F.min("review_id").alias("first"), F.count(F.lit(1)).alias("size")
    ).collect()
    found.sort(key=lambda r: r["first"])
    pairs = [
        (r["cluster_id"], new if r["size"] >= min_size else C.OTHER_CLUSTER_ID)
        for new, r in enumerate(found)
    ]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def silhouette(labelled: DataFrame, vector: str = "embedding") -> float:
    """Mean Euclidean silhouette of all rows of (review_id, cluster_id, vector); -1 with fewer than two clusters. Rows
    without a vector take no part. See euclidean_silhouette for its error on large clusters."""
    return euclidean_silhouette(labelled, vector).value


@dataclass
class KChoice:
    k: int
    silhouette: float
    scores: dict[int, float]


def select_k(
    reduced: DataFrame,
    k_min: int = C.K_MIN,
    k_max: int = C.K_MAX,
    seed: int = C.SEED,
    restarts: int = C.KMEANS_RESTARTS,
    max_iter: int = C.KMEANS_MAX_ITER,
) -> KChoice:
    """Fit every k; the highest Euclidean silhouette over all rows wins, the smaller k on a tie."""
    rows = kmeans.dealt(reduced).persist()
    try:
        return _search(rows, k_min, k_max, seed, restarts, max_iter)[0]
    finally:
        rows.unpersist()


def _search(
    rows: DataFrame, k_min: int, k_max: int, seed: int, restarts: int, max_iter: int
) -> tuple[KChoice, kmeans.Centers]:
    """The chosen k and its centers. With no more rows than k_min: k_min, and every row a center of its own."""
    n = rows.count()
    if n <= k_min:
        return KChoice(k_min, -1.0, {}), kmeans.fit(rows, [n], seed, 1, max_iter)[0]
    ks = [k for k in range(k_min, k_max + 1) if k <= n]
    fits = kmeans.fit(rows, ks, seed, restarts, max_iter)
    found = silhouettes(rows, fits, SEARCH_REFERENCES, seed)
    scores = {k: s.value for k, s in zip(ks, found)}
    chosen = max(scores, key=lambda k: (scores[k], -k))
    return KChoice(chosen, scores[chosen], scores), fits[ks.index(chosen)]


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def merge_tiny(
    assignments: DataFrame, min_size: int = C.MIN_CLUSTER_SIZE, sizes: DataFrame | None = None
) -> DataFrame:
    """Clusters below min_size become the "other" cluster."""
    sizes = pin(cluster_sizes(assignments)) if sizes is None else sizes
    tiny = sizes.where(F.col("size") < min_size).select("cluster_id", F.lit(True).alias("_tiny"))
    return (
        assignments.join(tiny, "cluster_id", "left")
        .withColumn("cluster_id", F.when(F.col("_tiny"), C.OTHER_CLUSTER_ID)
                    .otherwise(F.col("cluster_id")).cast("int"))
        .select(*assignments.columns)
    )


@dataclass
class Clustering:
    """members: the input rows with their cluster_id; representatives: cluster_id, review_id,
    rank; clusters: cluster_id, size, representatives in order; stats: one row."""

    members: DataFrame
    representatives: DataFrame
    clusters: DataFrame
    stats: DataFrame


def cluster_reviews(
    rows: DataFrame,
    k_min: int = C.K_MIN,
    k_max: int = C.K_MAX,
    pca_dim: int = C.PCA_DIM,
    min_size: int = C.MIN_CLUSTER_SIZE,
    restarts: int = C.KMEANS_RESTARTS,
    max_iter: int = C.KMEANS_MAX_ITER,
    seed: int = C.SEED,
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> Clustering:
    """PCA, choice of k, k-means on all rows, small-cluster merge, representatives.

    rows: review_id, embedding and whatever else should stay beside them. The models are applied
    to the rows where they are; the wide vectors are never shuffled or joined. keep stores the
    assigned rows, which the later passes read.
    """
    pca = fit_pca(rows, pca_dim)
    reduced = kmeans.dealt(materialize(project(pca, rows))).persist()
    try:
        choice, model = _search(reduced, k_min, k_max, seed, restarts, max_iter)
        numbers = _numbering(reduced.select("review_id", model.label("reduced").alias("cluster_id")), min_size)
    finally:
        reduced.unpersist()
    members = keep(
        pca.transform(_dense(rows))
        .withColumn("cluster_id", numbers[model.label(vector_to_array("_reduced"))])
        .drop("_dense", "_reduced")
    )
    return summarize(members, choice, pca.getK())


def summarize(members: DataFrame, choice: KChoice, pca_dim: int) -> Clustering:
    sizes = pin(cluster_sizes(members))
    picks = pin(representatives(members))
    clusters = (
        picks.groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "review_id"))).alias("_picks"))
        .join(sizes, "cluster_id")
        .select("cluster_id", "size", F.col("_picks.review_id").alias("representatives"))
    )
    other = F.col("cluster_id") == C.OTHER_CLUSTER_ID
    stats = sizes.agg(
        F.lit(choice.k).alias("k"),
        F.lit(float(choice.silhouette)).alias("sample_silhouette"),
        F.map_from_entries(F.collect_list(F.struct("cluster_id", "size"))).alias("cluster_sizes"),
        F.coalesce(F.sum(F.when(other, F.col("size"))), F.lit(0)).alias("other_count"),
        F.lit(pca_dim).alias("pca_dim"),
        F.count_if(~other).alias("surviving_clusters"),
    )
    return Clustering(members, picks, clusters, stats)
