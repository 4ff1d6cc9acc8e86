"""Representatives of a cluster: members nearest to its centroid, and diverse further ones.

Members are a frame (review_id, cluster_id, embedding). A cluster may hold any share of all rows:
similarities are computed where the rows are, every task keeps only its own best few per cluster,
and no task ever sees a whole cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from reviewmill import constants as C
from reviewmill.functions import vectors as V
from reviewmill.operators.scale import FAN_IN, pin, top_n_per_group

_BEST = "review_id bigint, cluster_id int, score double, embedding array<float>"
_PICK = "cluster_id int, review_id bigint, rank int"
_GREEDY = "cluster_id int, review_id bigint, rank int, embedding array<float>, more boolean"

#: Rows of a cluster among which the diverse picks are made before the members are read again; bytes of centroids and picks
#: that a task is given at once.
POOL = 64
STATE_BYTES = 32 << 20


def cluster_centroids(members: DataFrame) -> DataFrame:
    """cluster_id, size, centroid (mean vector): partial sums per task, merged in two levels."""
    partial = (
        members.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
        .groupBy("cluster_id", "_slice")
        .agg(
            Summarizer.metrics("sum").summary(array_to_vector("embedding")).alias("part"),
            F.count(F.lit(1)).alias("n"),
        )
        .select("cluster_id", "n", F.col("part.sum").alias("total"))
    )
    return (
        partial.groupBy("cluster_id")
        .agg(
            F.sum("n").alias("size"),
            Summarizer.metrics("sum").summary(F.col("total")).alias("whole"),
        )
        .select(
            "cluster_id",
            "size",
            F.transform(
                vector_to_array(F.col("whole.sum")), lambda x: x / F.col("size")
            ).alias("centroid"),
        )
    )


# --- what is known about each cluster while picking ----------------------------------


@dataclass
class _Cluster:
    centroid: np.ndarray
    diverse: list[np.ndarray] = field(default_factory=list)
    taken: list[int] = field(default_factory=list)


def _scores(unit: np.ndarray, cluster: _Cluster, lam: float | None) -> np.ndarray:
    """Without lam the cosine to the centroid. With lam that cosine against the largest cosine to a diverse pick made so far
    (0 while there is none)."""
    score = unit @ cluster.centroid
    if lam is not None:
        penalty = (unit @ np.array(cluster.diverse).T).max(axis=1) if cluster.diverse else 0.0
        score = lam * score - (1 - lam) * penalty
    return score


def _best_here(clusters: dict[int, _Cluster], n: int, lam: float | None):
    """Arrow-batch function: the n best rows per cluster of one partition that are not taken."""
    epsilon = C.NORM_EPSILON

    def run(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("review_id"))
            labels = np.asarray(batch.column("cluster_id"))
            raw = np.asarray(batch.column("embedding").flatten()).reshape(len(ids), -1)
            for cid in np.unique(labels):
                if cid not in clusters:
                    continue
                own = clusters[cid]
                rows = np.flatnonzero((labels == cid) & ~np.isin(ids, own.taken))
                unit = raw[rows].astype(np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True) + epsilon
                kept = (_scores(unit, own, lam), ids[rows], raw[rows])
                if cid in held:
                    kept = tuple(np.concatenate(pair) for pair in zip(held[cid], kept))
                order = np.lexsort((kept[1], -kept[0]))[:n]
                held[cid] = tuple(part[order] for part in kept)
        for cid, (score, ids, raw) in held.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(np.full(len(ids), cid), pa.int32()),
                        pa.array(score, pa.float64()),
                        pa.array(list(raw), pa.list_(pa.float32())),
                    ],
                    names=["review_id", "cluster_id", "score", "embedding"],
                )

    return run


def _plain_members(members: DataFrame) -> DataFrame:
    """Members without a vector are near to nothing: they are left out here."""
    return members.where("embedding IS NOT NULL").select(
        F.col("review_id").cast("bigint"),
        F.col("cluster_id").cast("int"),
        F.col("embedding").cast("array<float>"),
    )


def _centroid_blocks(centroids: DataFrame, n: int) -> Iterator[dict[int, _Cluster]]:
    """All clusters in order of their ids, as many at a time as STATE_BYTES hold with n picks each."""
    after, width = None, centroids.select(F.max(F.size("centroid"))).first()[0]
    if width is None:
        return
    size = max(1, STATE_BYTES // (8 * width * (n + 1)))
    while True:
        left = centroids if after is None else centroids.where(F.col("cluster_id") > after)
        rows = left.select("cluster_id", "centroid").orderBy("cluster_id").limit(size).toArrow().to_pydict()
        if not rows["cluster_id"]:
            return
        unit = V.unit_rows(rows["centroid"])
        yield {cid: _Cluster(unit[i]) for i, cid in enumerate(rows["cluster_id"])}
        after = rows["cluster_id"][-1]


def _ranked(members: DataFrame, clusters: dict[int, _Cluster], n: int, lam: float | None = None) -> DataFrame:
    """review_id, cluster_id, score, embedding, rank: the n best of each of these clusters, in one pass over the members."""
    of_block = members.where(F.col("cluster_id").between(min(clusters), max(clusters)))
    best = of_block.mapInArrow(_best_here(clusters, n, lam), _BEST)
    return top_n_per_group(best, ["cluster_id"], [F.desc("score"), F.asc("review_id")], n)


# --- operators ------------------------------------------------------------------------


def nearest_per_cluster(members: DataFrame, n: int, centroids: DataFrame | None = None) -> DataFrame:
    """cluster_id, review_id, score, rank: the n members most similar to their centroid. Any number of clusters: one pass
    over the members for as many as STATE_BYTES hold."""
    members = _plain_members(members)
    if centroids is None:
        centroids = pin(cluster_centroids(members))
    return _nearest(members, n, centroids).select("cluster_id", "review_id", "score", "rank")


def _nearest(members: DataFrame, n: int, centroids: DataFrame, lam: float | None = None) -> DataFrame:
    ranked = [_ranked(members, block, n, lam) for block in _centroid_blocks(centroids, 0)]
    empty = members.sparkSession.createDataFrame([], f"{_BEST}, rank int")
    return reduce(DataFrame.unionByName, ranked) if ranked else empty


def mmr_per_cluster(
    members: DataFrame,
    exclude: DataFrame,
    n: int,
    lam: float = C.MMR_LAMBDA,
    centroids: DataFrame | None = None,
    pool: int = POOL,
) -> DataFrame:
    """cluster_id, review_id, rank: greedy maximal-marginal-relevance picks, n per cluster.

    exclude (cluster_id, review_id) cannot be picked but does not count as picked either.
    """
    members = _plain_members(members)
    if centroids is None:
        centroids = pin(cluster_centroids(members))
    keys = ["cluster_id", "review_id"]
    candidates = members.join(pin(exclude.select(keys)), keys, "left_anti")
    first = _nearest(candidates, 1, centroids, lam) if n > 0 else None
    return _diverse(candidates, first, n, lam, centroids, pool)


def _diverse(
    candidates: DataFrame, first: DataFrame | None, n: int, lam: float, centroids: DataFrame, pool: int
) -> DataFrame:
    """Greedy picks after the first one, which is the candidate most similar to the centroid.

    From then on scores only fall, since each pick can only raise a row's largest cosine to the picks. So one pass takes the
    best `pool` rows of every cluster under the picks made so far; the score of the last of them bounds all rows outside.
    Picks are made inside the pool, in tasks, while the best score lies above that bound. Only clusters where it does not
    read the members again; the first of a new pool is always a pick, so every pass makes progress.
    """
    spark = candidates.sparkSession
    picks = [spark.createDataFrame([], _PICK)]
    if n > 0:
        first = pin(first.select("cluster_id", "review_id", F.lit(1).alias("rank"), "embedding"))
        picks.append(first.select("cluster_id", "review_id", "rank"))
    for clusters in _centroid_blocks(centroids, n) if n > 1 else ():
        of_block = F.col("cluster_id").between(min(clusters), max(clusters))
        made = first.where(of_block)
        while True:
            for row in made.toArrow().to_pylist():  # at most n vectors of each cluster of the block
                clusters[row["cluster_id"]].taken.append(row["review_id"])
                clusters[row["cluster_id"]].diverse.append(V.unit_rows([row["embedding"]])[0])
            clusters = {cid: c for cid, c in clusters.items() if 0 < len(c.taken) < n}
            if not clusters:
                break
            best = _ranked(candidates, clusters, max(pool, 2), lam)
            found = pin(best.groupBy("cluster_id").applyInPandas(_greedy(clusters, n, lam, max(pool, 2)), _GREEDY))
            made = found.where("review_id IS NOT NULL")
            picks.append(made.select("cluster_id", "review_id", "rank"))
            unfinished = {r[0] for r in found.where("more").select("cluster_id").collect()}
            clusters = {cid: c for cid, c in clusters.items() if cid in unfinished}
            made = made.where("more")
    return reduce(DataFrame.unionByName, picks)


def _greedy(clusters: dict[int, _Cluster], n: int, lam: float, pool: int):
    """Pandas function for the pool of one cluster: its next picks, and whether more are to come from a new pool."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = clusters[int(rows["cluster_id"].iloc[0])]
        rows = rows.sort_values("rank")
        ids, raw = rows["review_id"].to_numpy(), rows["embedding"].to_numpy()
        unit = np.stack(raw).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True) + C.NORM_EPSILON
        bound = rows["score"].iloc[-1] if len(rows) >= pool else -np.inf
        diverse, chosen = list(own.diverse), []
        while len(own.taken) + len(chosen) < n and len(chosen) < len(rows):
            # the score of the pass for the first one, so that it is the pass's first row
            score = rows["score"].to_numpy().copy() if not chosen else _scores(unit, _Cluster(own.centroid, diverse), lam)
            score[chosen] = -np.inf
            best = np.lexsort((ids, -score))[0]
            if chosen and not score[best] > bound:
                break
            chosen.append(int(best))
            diverse.append(unit[best])
        more = len(own.taken) + len(chosen) < n and len(rows) >= pool
        return pd.DataFrame({
            "cluster_id": rows["cluster_id"].iloc[0], "review_id": ids[chosen],
            "rank": np.arange(len(chosen)) + len(own.taken) + 1, "embedding": [raw[i] for i in chosen], "more": more,
        })

    return run


def representatives(
    members: DataFrame,
    n_total: int = C.REPRESENTATIVES_PER_CLUSTER,
    n_nearest: int | None = None,
    lam: float = C.MMR_LAMBDA,
    centroids: DataFrame | None = None,
    pool: int = POOL,
) -> DataFrame:
    """cluster_id, review_id, rank: the nearest half in order, then the diverse half.

    One pass finds the nearest and, right behind them, the first diverse pick; a second one the pool of the others.
    """
    n_nearest = n_total // 2 if n_nearest is None else n_nearest
    members = _plain_members(members)
    if centroids is None:
        centroids = pin(cluster_centroids(members))
    ranked = pin(_nearest(members, n_nearest + 1, centroids))
    nearest = ranked.where(F.col("rank") <= n_nearest).select("cluster_id", "review_id", "rank")
    candidates = members.join(nearest.select("cluster_id", "review_id"), ["cluster_id", "review_id"], "left_anti")
    # while nothing is picked only the centroid counts, unless it has no weight at all
    first = ranked.where(F.col("rank") == n_nearest + 1) if lam > 0 else _nearest(candidates, 1, centroids, lam)
    diverse = _diverse(candidates, first, n_total - n_nearest, lam, centroids, pool)
    return nearest.unionByName(diverse.withColumn("rank", F.col("rank") + F.lit(n_nearest)))


def negative_sample(
    negatives: DataFrame,
    n_total: int = C.NEGATIVE_SAMPLE_SIZE,
    n_nearest: int = C.NEGATIVE_NEAREST,
    lam: float = C.MMR_LAMBDA,
    pool: int = POOL,
) -> DataFrame:
    """cluster_id, review_id, rank over the negative members of each cluster.

    A cluster with at most n_total negatives gives all of them in id order; a larger one gives its
    n_nearest nearest to the centroid of the negatives and diverse ones for the rest, of those that
    have a vector.
    """
    ids = negatives.select(F.col("cluster_id").cast("int"), F.col("review_id").cast("bigint"))
    sizes = pin(ids.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")))
    few = sizes.where(F.col("size") <= n_total).select("cluster_id")
    many = sizes.where(F.col("size") > n_total).select("cluster_id")
    everything = top_n_per_group(
        ids.join(few, "cluster_id", "left_semi"), ["cluster_id"], [F.asc("review_id")], n_total,
    )
    centroids = pin(
        cluster_centroids(_plain_members(negatives)).join(many, "cluster_id", "left_semi")
    )
    chosen = representatives(negatives, n_total, n_nearest, lam, centroids, pool)
    return everything.unionByName(chosen)
