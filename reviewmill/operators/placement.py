"""The most similar of any number of centroids for each vector.

Centroids are packed into blocks of similar ones. By the triangle inequality for angles, no centroid of a block is nearer to
a row than the angle to the block's middle less the block's widest angle, so most blocks are ruled out before any product
is made. Blocks of rows meet the blocks of centroids that are left in a join, which gives the best of each block for every
row; the best of these wins. Spark copies the centroids to the tasks while they are small, and shuffles both sides else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewmill.functions.vectors import unit_rows
from reviewmill.operators.scale import arrow_vectors, materialize, pin

#: Centroids and rows of a block; directions by which centroids are grouped.
CENTROIDS_A_BLOCK, ROWS_A_BLOCK, DIRECTIONS = 1_024, 1_024, 64
#: What rounding may add to a cosine.
SLACK = 1e-6

_BLOCK = "block string, ids binary, matrix binary, middle binary, widest double"


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, block: int = CENTROIDS_A_BLOCK) -> DataFrame:
    """Adds cluster_id and similarity (cosine) of the most similar centroid; the lowest cluster_id wins a tie.

    vectors: rows with an embedding, which need no key; without an embedding, or without any centroid, both are NULL.
    centroids: cluster_id, centroid; any number of them. The driver sees one middle a block and at most DIRECTIONS of the
    centroids.
    """
    blocks = _blocks(centroids, block)
    middles = blocks.select("block", "middle", "widest").orderBy("block").toArrow().to_pydict()
    kind = centroids.schema["cluster_id"].dataType
    if len(middles["block"]) == 1:
        return _nearest_of(vectors, blocks.select("ids", "matrix").first(), kind)
    numbered = materialize(vectors.withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered.where("embedding IS NOT NULL").select("_row", "embedding")
    pieces = rows.mapInArrow(_needed(middles), "block string, rows binary, vectors binary")
    best = (
        pieces.join(blocks.select("block", "ids", "matrix"), "block")
        .mapInArrow(_best_of_block, "_row bigint, similarity double, tie bigint")
        .groupBy("_row").agg(F.max(F.struct("similarity", "tie")).alias("_best"))
    )
    return numbered.join(best, "_row", "left").select(
        *vectors.columns, (-F.col("_best.tie")).cast(kind).alias("cluster_id"), F.col("_best.similarity").alias("similarity")
    )


def _nearest_of(vectors: DataFrame, block, kind) -> DataFrame:
    """The same where all centroids are one block, which goes to every task: each row is placed where it lies."""
    ids, centers = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["matrix"]).reshape(-1, len(block["matrix"]) // len(block["ids"]))

    def place(column: pa.Array) -> pa.Array:
        present = np.asarray(column.is_valid())
        nearest, similarity = np.zeros(len(column), np.int64), np.zeros(len(column))
        if present.any():
            unit = unit_rows(arrow_vectors(column.drop_null()))
            if unit.shape[1] != centers.shape[1]:
                raise ValueError("vectors differ in width from the centroids")
            cosines = unit @ centers.T
            first = cosines.argmax(axis=1)  # ids are in order: the lowest of equal ones
            nearest[present], similarity[present] = ids[first], cosines[np.arange(len(first)), first]
        missing = pa.array(~present)
        return pa.StructArray.from_arrays([pa.array(nearest), pa.array(similarity)], names=["cluster_id", "similarity"], mask=missing)

    placed = F.arrow_udf(place, "struct<cluster_id: bigint, similarity: double>")(F.col("embedding"))
    return vectors.select(*vectors.columns, placed.alias("_best")).select(
        *vectors.columns, F.col("_best.cluster_id").cast(kind).alias("cluster_id"), F.col("_best.similarity").alias("similarity"))


def _blocks(centroids: DataFrame, size: int) -> DataFrame:
    """A row a block: ids in order, unit vectors, their middle, and the widest angle from it."""
    known = centroids.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), F.col("centroid").alias("embedding"))
    n = known.count()
    wanted = min(DIRECTIONS, -(-n // size))
    chosen = known.orderBy(F.xxhash64("cluster_id"), "cluster_id").limit(wanted).toArrow()
    directions = unit_rows(arrow_vectors(chosen.column("embedding").combine_chunks())) if wanted else np.zeros((0, 0))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = unit_rows(arrow_vectors(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cluster_id"), pa.array((unit @ directions.T).argmax(axis=1), pa.int32()),
                     pa.array(list(unit), pa.list_(pa.float64()))], names=["cluster_id", "direction", "unit"])

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cluster_id")
        unit = np.stack(rows["unit"])
        middle = unit_rows([unit.mean(axis=0)])[0]
        return pd.DataFrame({
            "block": [f"{rows['direction'].iloc[0]}-{rows['part'].iloc[0]}"], "ids": [rows["cluster_id"].to_numpy(np.int64).tobytes()],
            "matrix": [unit.tobytes()], "middle": [middle.tobytes()], "widest": [float(_angle((unit @ middle).min()))],
        })

    placed = pin(known.mapInArrow(grouped, "cluster_id bigint, direction int, unit array<double>"))
    parts = pin(placed.groupBy("direction").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts")))
    dealt = placed.join(parts, "direction").withColumn("part", F.pmod(F.xxhash64("cluster_id"), F.col("parts")))
    return pin(dealt.groupBy("direction", "part").applyInPandas(packed, _BLOCK))


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _needed(middles: dict):
    """Arrow-batch function: the rows that each block may hold the best centroid of, as blocks of rows."""
    names = middles["block"]
    matrix = np.array([np.frombuffer(m) for m in middles["middle"]])
    widest = np.array(middles["widest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if names else ():
            if not batch.num_rows:
                continue
            ids = batch.column("_row").to_numpy()
            unit = unit_rows(arrow_vectors(batch.column("embedding")))
            if unit.shape[1] != matrix.shape[1]:
                raise ValueError("vectors differ in width from the centroids")
            angle = _angle(unit @ matrix.T)
            most = np.cos(np.maximum(angle - widest, 0.0))  # no centroid of the block is more similar
            least = np.cos(np.minimum(angle + widest, np.pi)).max(axis=1, keepdims=True)  # some centroid is as similar
            wanted = most >= least - SLACK
            for i, name in enumerate(names):
                own = np.flatnonzero(wanted[:, i])
                for begin in range(0, len(own), ROWS_A_BLOCK):
                    piece = own[begin : begin + ROWS_A_BLOCK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([ids[piece].tobytes()], pa.binary()),
                         pa.array([unit[piece].tobytes()], pa.binary())], names=["block", "rows", "vectors"])

    return run


def _best_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rows, ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
            unit = np.frombuffer(row["vectors"]).reshape(len(rows), -1)
            cosines = unit @ np.frombuffer(row["matrix"]).reshape(len(ids), -1).T
            first = cosines.argmax(axis=1)  # ids are in order: the lowest of equal ones
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(cosines[np.arange(len(rows)), first]), pa.array(-ids[first])],
                names=["_row", "similarity", "tie"])
