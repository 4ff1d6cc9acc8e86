import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from reviewmill.operators import clustering, kmeans, scale, silhouette


@pytest.fixture(scope="module")
def blobs(spark, rng):
    """Seven well separated groups; the first holds more than a third, the last is tiny."""
    sizes = [160, 60, 60, 50, 40, 30, 6]
    centers = rng.normal(size=(7, 12)) * 12
    rows, rid = [], 100
    for c, n in enumerate(sizes):
        for _ in range(n):
            rows.append((rid, c, [float(v) for v in centers[c] + rng.normal(size=12)]))
            rid += 1
    return spark.createDataFrame(
        rows, "review_id bigint, truth int, embedding array<float>").repartition(4)


def brute_silhouette(x, labels, power=1):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) ** (power / 2)
    out = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == o].mean() for o in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def frame_of(spark, x, labels):
    return spark.createDataFrame(
        [(i, int(l), [float(v) for v in row]) for i, (l, row) in enumerate(zip(labels, x))],
        "review_id bigint, cluster_id int, embedding array<double>").repartition(3)


def test_silhouette_equals_brute_force(spark, rng):
    x = rng.normal(size=(60, 5))
    labels = np.array([0] * 30 + [1] * 20 + [2] * 9 + [3])
    df = frame_of(spark, x, labels)
    assert clustering.silhouette(df) == pytest.approx(brute_silhouette(x, labels), abs=1e-9)
    assert silhouette.squared_silhouette(df) == pytest.approx(brute_silhouette(x, labels, 2), abs=1e-9)


def test_silhouette_of_one_cluster_is_minus_one(members):
    assert clustering.silhouette(members.withColumn("cluster_id", F.lit(1))) == -1.0
    assert silhouette.squared_silhouette(members.withColumn("cluster_id", F.lit(1))) == -1.0
    assert clustering.silhouette(members.limit(0)) == -1.0


def test_silhouette_covers_every_row(spark, rng):
    x = rng.normal(size=(2500, 3))
    labels = np.arange(2500) % 3
    df = frame_of(spark, x, labels)
    assert clustering.silhouette(df) == pytest.approx(brute_silhouette(x, labels), abs=1e-9)
    missing = spark.createDataFrame([(9000, 1, None)], df.schema)
    assert clustering.silhouette(df.unionByName(missing)) == pytest.approx(clustering.silhouette(df))


@pytest.mark.parametrize("shape, allowed", [("blobs", 0.03), ("outliers", (5 / 200) ** 0.5)])
def test_sampled_references_stay_within_the_stated_error(spark, rng, shape, allowed):
    labels = rng.choice([0, 0, 0, 1, 2], size=3000)
    x = rng.normal(size=(3000, 6)) + 1.5 * labels[:, None]
    if shape == "outliers":  # a few members far away carry most of the distance
        x[:20] *= 200
    found = silhouette.euclidean_silhouette(frame_of(spark, x, labels), references=600)
    assert found.error == pytest.approx((5 / 200) ** 0.5)
    assert found.value == pytest.approx(brute_silhouette(x, labels), abs=allowed)
    again = silhouette.euclidean_silhouette(frame_of(spark, x, labels).repartition(7), references=600)
    assert again.value == pytest.approx(found.value, abs=1e-9)


def test_silhouette_takes_all_pairs_of_large_clusters(spark, rng):
    """More clusters share the references than a sample of the largest could be exact with: nothing is sampled."""
    labels = np.concatenate([np.zeros(300, int), np.repeat(np.arange(1, 512), 2)])
    x = rng.normal(size=(len(labels), 4)) * (1 + labels[:, None] % 7)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    sizes = np.bincount(labels)
    sums = d @ np.eye(512)[labels]
    row = np.arange(len(x))
    a = sums[row, labels] / (sizes[labels] - 1)
    sums[row, labels] = np.inf
    b = (sums / sizes).min(1)
    found = silhouette.euclidean_silhouette(frame_of(spark, x, labels))
    assert found.error == 0.0
    assert found.value == pytest.approx(float(((b - a) / np.maximum(a, b)).mean()), abs=1e-9)


def test_distances_of_rows_close_together_do_not_cancel(rng, monkeypatch):
    x = rng.normal(size=(40, 3))
    x[10:20] = x[0]
    x[20:30] = x[1] * (1 + 1e-9)
    labels = np.sort(np.arange(40, dtype=np.int32) % 3)
    monkeypatch.setattr(silhouette, "DISTANCES_AT_ONCE", 100)
    blocks = [(x[i: i + 7], labels[i: i + 7]) for i in range(0, 40, 7)]
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    expected = d @ np.eye(3)[labels]
    assert np.allclose(silhouette._distance_sums(x, iter(blocks), 3), expected, rtol=1e-12, atol=0)
    same = np.tile(rng.normal(size=3), (9, 1))
    assert not silhouette._distance_sums(same, iter([(same, np.zeros(9, np.int32))]), 1).any()


def test_too_many_clusters_for_references(spark):
    rows = spark.range(1100).selectExpr("id AS review_id", "CAST(id AS INT) AS cluster_id", "array(0D, 1D) AS embedding")
    with pytest.raises(ValueError):
        silhouette.euclidean_silhouette(rows)


def test_equal_rows_have_silhouette_zero(spark):
    rows = spark.range(8).selectExpr("id AS review_id", "CAST(id % 2 AS INT) AS cluster_id", "array(1D, 2D) AS embedding")
    assert silhouette.euclidean_silhouette(rows).value == 0.0


def test_pca_keeps_distances_and_caps_the_dimension(blobs):
    reduced = clustering.pca_projection(blobs, 50)
    rows = reduced.orderBy("review_id").toPandas()
    z = np.stack(rows["reduced"])
    x = np.stack(blobs.orderBy("review_id").toPandas()["embedding"]).astype(float)
    assert z.shape == (len(x), 12)
    assert np.allclose(np.linalg.norm(z[0] - z[1:], axis=1), np.linalg.norm(x[0] - x[1:], axis=1),
                       atol=1e-4)
    few = clustering.pca_projection(blobs.orderBy("review_id").limit(4), 50)
    assert few.select(F.size("reduced")).first()[0] == 3


def test_components_are_ordered_by_variance(blobs):
    z = np.stack(clustering.pca_projection(blobs, 4).toPandas()["reduced"])
    v = z.var(axis=0)
    assert (np.diff(v) <= 1e-9).all()


def test_select_k_finds_the_groups(blobs):
    reduced = scale.materialize(clustering.pca_projection(blobs))
    choice = clustering.select_k(reduced, restarts=4)
    assert list(choice.scores) == [6, 7, 8, 9, 10]
    assert choice.k == 7 and choice.silhouette == max(choice.scores.values())
    again = clustering.select_k(reduced.repartition(5), restarts=4)
    assert again.k == choice.k
    assert again.scores == pytest.approx(choice.scores, abs=1e-9)


def test_select_k_with_fewer_rows_than_clusters(blobs):
    reduced = clustering.pca_projection(blobs.orderBy("review_id").limit(5))
    assert clustering.select_k(reduced, restarts=1) == clustering.KChoice(6, -1.0, {})


def test_best_restart_has_the_lowest_cost(blobs):
    rows = kmeans.dealt(clustering.pca_projection(blobs)).persist()
    best = kmeans.fit(rows, [7], restarts=4)[0].cost
    single = [kmeans.fit(rows, [7], seed=42 + i, restarts=1)[0].cost for i in range(4)]
    assert best == pytest.approx(min(single))


def spark_cost(rows, k, restarts):
    features = rows.select(array_to_vector("reduced").alias("features")).persist()
    return min(KMeans(k=k, seed=s, maxIter=300, tol=1e-6).fit(features).summary.trainingCost for s in range(restarts))


@pytest.mark.parametrize("size", [kmeans.CORESET_ROWS, 1500])
def test_cost_is_that_of_full_runs(spark, rng, size):
    """With the coreset all rows, and with a coreset of a fifth of them."""
    x = np.concatenate([rng.normal(size=(n, 6)) * s + rng.normal(size=6) * 6
                        for n, s in ((3000, 1), (2000, 2), (1500, 1), (800, 3), (200, 1))])
    rows = kmeans.dealt(spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)], "review_id bigint, reduced array<double>")).persist()
    sample = kmeans.coreset(rows, size)
    assert sample.rows == len(x)
    assert sample.weights.sum() == pytest.approx(len(x), rel=0.1 if size < len(x) else 0)
    for found in kmeans.fit(rows, [5, 7], restarts=6, size=size):
        assert found.cost <= 1.01 * spark_cost(rows, found.k, 3)
        labels, gap = kmeans.nearest_centers(x, found.centers)
        assert found.cost == pytest.approx(gap.sum())
        means = np.stack([x[labels == c].mean(axis=0) for c in range(found.k)])
        assert np.abs(means - found.centers).max() < 0.05  # settled on all rows


def test_few_rows_and_equal_rows(spark):
    same = spark.range(30).selectExpr("id AS review_id", "array(1D, 2D) AS reduced")
    labels = {r["cluster_id"] for r in clustering.kmeans_assign(same, 3, restarts=2).collect()}
    assert labels == {0}
    with pytest.raises(ValueError):
        kmeans.fit(kmeans.dealt(same.limit(2)), [3])
    choice = clustering.select_k(same, restarts=1)
    assert choice.k == 6 and set(choice.scores.values()) == {-1.0}


def test_labels_of_missing_vectors_are_missing(spark):
    model = kmeans.Centers(np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 0.0]]), 0.0)
    rows = spark.createDataFrame([([1.0, 0.0],), (None,), ([2.0, 5.0],), ([9.0, 0.0],)], "v array<double>")
    assert [r[0] for r in rows.coalesce(1).select(model.label("v")).collect()] == [0, None, 0, 1]


def test_assignment_is_repeatable_and_numbered_by_first_id(spark, rng, blobs):
    x = rng.normal(size=(1500, 8))  # no groups: any change of the start shows
    flat = scale.materialize(spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)], "review_id bigint, reduced array<double>"))
    runs = [sorted(clustering.kmeans_assign(flat.repartition(n), 6, restarts=3).collect()) for n in (2, 4, 7)]
    assert runs[0] == runs[1] == runs[2]
    reduced = scale.materialize(clustering.pca_projection(blobs))
    first = clustering.kmeans_assign(reduced, 7, restarts=2)
    order = [r[0] for r in first.groupBy("cluster_id").agg(F.min("review_id").alias("m"))
             .orderBy("m").collect()]
    assert order == sorted(order)


@pytest.mark.parametrize("min_size, other", [(20, 6), (1, 0)])
def test_whole_job(blobs, min_size, other):
    job = clustering.cluster_reviews(blobs, restarts=4, min_size=min_size)
    stats = job.stats.first()
    assert stats["k"] == 7 and stats["other_count"] == other and stats["pca_dim"] == 12
    assert sum(stats["cluster_sizes"].values()) == 406
    assert stats["surviving_clusters"] == (6 if other else 7)
    assert job.members.columns == ["review_id", "truth", "embedding", "cluster_id"]
    purity = job.members.groupBy("cluster_id").agg(F.count_distinct("truth").alias("n")).collect()
    assert all(r["n"] == 1 for r in purity)
    for row in job.clusters.collect():
        reps = row["representatives"]
        assert len(reps) == min(10, row["size"]) and len(set(reps)) == len(reps)


def test_merge_keeps_every_row(members):
    merged = clustering.merge_tiny(members.select("review_id", "cluster_id"), 13)
    sizes = {r["cluster_id"]: r["size"] for r in clustering.cluster_sizes(merged).collect()}
    assert sizes == {0: 40, -1: 15}


def test_distances_held_at_once_are_bounded(rng, monkeypatch):
    """The references are many, so the rows whose distances to them are held at once are few."""
    import tracemalloc

    points = rng.normal(size=(32_768, 8))
    sizes = np.full(64, 512.0)
    group = silhouette._Groups(sizes, np.zeros((64, 8)), points, np.ones(len(points)), np.arange(64) * 512)
    x = rng.normal(size=(600, 8))
    monkeypatch.setattr(silhouette, "_groups", lambda *a: [group])
    monkeypatch.setattr(silhouette, "_with_references", lambda *a: [group])
    peaks = []

    def summed(rows, part):
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], names=["reduced"])
        tracemalloc.start()
        total = part(batch)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return total

    monkeypatch.setattr(silhouette, "sum_over", summed)
    silhouette._silhouettes(None, lambda b, x: [np.arange(len(x)) % 64], [64], 32_768, 1)
    assert peaks[0] < 64 << 20
