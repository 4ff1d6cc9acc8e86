import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.functions.vectors import unit_rows
from reviewmill.operators import placement, selection


def cosine(u, v):
    return float(np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v)))


@pytest.mark.parametrize("block", [1, 2, 100])
def test_nearest_centroid_in_blocks(members, block):
    centroids = selection.cluster_centroids(members)
    placed = placement.nearest_centroid(
        members.select("review_id", "embedding"), centroids, block
    ).toPandas().sort_values("review_id")
    c = centroids.toPandas().sort_values("cluster_id")
    x = np.stack(members.toPandas().sort_values("review_id")["embedding"]).astype(float)
    expected = np.array([[cosine(v, m) for m in c["centroid"]] for v in x])
    assert placed["cluster_id"].tolist() == c["cluster_id"].to_numpy()[expected.argmax(1)].tolist()
    assert np.allclose(placed["similarity"], expected.max(axis=1))


def centroid_frame(spark, matrix):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "cluster_id int, centroid array<double>").repartition(5)


def row_frame(spark, matrix):
    rows = [(f"r{i % 7}", None if row is None else [float(v) for v in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "name string, embedding array<float>").repartition(4)


@pytest.mark.parametrize("shape", ["grouped", "even"])
def test_many_centroids_equal_brute_force(spark, rng, shape, monkeypatch):
    middles = rng.normal(size=(60, 12)) * (4 if shape == "grouped" else 0)
    centroids = np.repeat(middles, 50, axis=0) + rng.normal(size=(3000, 12)) * 0.3
    x = np.concatenate([centroids[rng.integers(0, 3000, 400)], rng.normal(size=(100, 12))]).astype(np.float32)
    pieces = []
    plain = placement._needed
    monkeypatch.setattr(placement, "_needed", lambda m: pieces.append(len(m["block"])) or plain(m))
    placed = placement.nearest_centroid(row_frame(spark, x), centroid_frame(spark, centroids), 64).toPandas()
    assert pieces[0] >= 3000 / 64
    cosines = unit_rows(x) @ unit_rows(centroids).T
    want = sorted(zip(cosines.argmax(axis=1).tolist(), cosines.max(axis=1).round(9).tolist()))
    assert sorted(zip(placed["cluster_id"], placed["similarity"].round(9))) == want


def test_blocks_are_ruled_out(rng):
    middles = unit_rows(rng.normal(size=(40, 16)))
    needed = placement._needed({"block": list(map(str, range(40))), "middle": [m.tobytes() for m in middles], "widest": [0.1] * 40})
    import pyarrow as pa

    x = unit_rows(middles[:20] + rng.normal(size=(20, 16)) * 0.02)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(20)), pa.array(list(x), pa.list_(pa.float64()))], names=["_row", "embedding"])
    met = sum(len(b.column("rows")[0].as_py()) // 8 for b in needed([batch]))
    assert 20 <= met < 60  # of 800 pairs of row and block


def test_fifty_thousand_centroids_stay_off_the_driver(spark):
    grid = spark.range(50_000).select(
        F.col("id").cast("int").alias("cluster_id"),
        F.array(F.cos(F.col("id") * 1e-4), F.sin(F.col("id") * 1e-4), F.lit(0.2)).alias("centroid"))
    rows = spark.range(0, 50_000, 997).select(
        "id", F.array(*[x.cast("float") for x in (F.cos(F.col("id") * 1e-4), F.sin(F.col("id") * 1e-4), F.lit(0.2))]).alias("embedding"))
    blocks = placement._blocks(grid, placement.CENTROIDS_A_BLOCK)
    assert 49 <= blocks.count() <= 200
    placed = placement.nearest_centroid(rows, grid).collect()
    assert len(placed) == 51 and all(abs(r["id"] - r["cluster_id"]) <= 20 for r in placed)


def test_ties_repeats_and_missing_vectors(spark):
    centroids = centroid_frame(spark, [[1, 0], [0, 1], [1, 0], [0, 1]])
    rows = row_frame(spark, [[3, 0], [3, 0], None, [0, 0], [0, 5]])
    found = placement.nearest_centroid(rows, centroids, 1).collect()
    got = sorted((r["cluster_id"] is None, r["cluster_id"], round(r["similarity"], 9)) for r in found if r["embedding"] is not None)
    assert got == [(False, 0, 0.0), (False, 0, 1.0), (False, 0, 1.0), (False, 1, 1.0)]
    missing = [r for r in found if r["embedding"] is None]
    assert [(r["cluster_id"], r["similarity"]) for r in missing] == [(None, None)]
    none = placement.nearest_centroid(rows, centroids.where("cluster_id > 9")).collect()
    assert len(none) == 5 and {r["cluster_id"] for r in none} == {None}
    assert placement.nearest_centroid(rows.limit(0), centroids).collect() == []


def test_one_block_moves_no_row(spark, rng):
    centroids = centroid_frame(spark, rng.normal(size=(30, 6)))
    placed = placement.nearest_centroid(row_frame(spark, rng.normal(size=(100, 6))), centroids)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and placed.count() == 100
