import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.plans import plan_of
from reviewmill.operators import selection


def cosine(u, v):
    return float(np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v)))


def brute_force(members, n_near, n_mmr, lam=0.6):
    """Per cluster, ids in pick order: every step ranks all remaining rows anew."""
    result = {}
    for cid, part in members.toPandas().groupby("cluster_id"):
        vec = {r.review_id: np.array(r.embedding, dtype=float) for r in part.itertuples()}
        center = sum(vec.values()) / len(vec)
        rel = {i: cosine(v, center) for i, v in vec.items()}
        picked = sorted(vec, key=lambda i: (-rel[i], i))[:n_near]
        diverse = []
        for _ in range(min(n_mmr, len(vec) - len(picked))):
            def value(i):
                crowding = max((cosine(vec[i], vec[j]) for j in diverse), default=0.0)
                return lam * rel[i] - (1 - lam) * crowding

            diverse.append(min(set(vec) - set(picked) - set(diverse), key=lambda i: (-value(i), i)))
        result[cid] = picked + diverse
    return result


def by_cluster(df):
    out = {}
    for r in df.orderBy("cluster_id", "rank").collect():
        out.setdefault(r["cluster_id"], []).append(r["review_id"])
    return out


@pytest.fixture(params=["all clusters at once", "one cluster at a time"])
def blocks(request, monkeypatch):
    if request.param == "one cluster at a time":
        monkeypatch.setattr(selection, "STATE_BYTES", 1)


@pytest.mark.parametrize("pool", [selection.POOL, 7, 1])
def test_representatives_equal_brute_force(members, pool, blocks):
    got = selection.representatives(members, pool=pool)
    assert by_cluster(got) == brute_force(members, 5, 5)
    ranks = [r["rank"] for r in got.where("cluster_id = 0").orderBy("rank").collect()]
    assert ranks == list(range(1, 11))


def test_negative_sample_takes_all_of_small_clusters(members, blocks):
    got = by_cluster(selection.negative_sample(members, 12, 4))
    assert got[0] == brute_force(members, 4, 8)[0]
    assert got[1] == list(range(40, 52))
    assert got[2] == [52, 53, 54]


def passes(monkeypatch):
    made = []
    ranked = selection._ranked
    monkeypatch.setattr(selection, "_ranked", lambda *a: made.append(sorted(a[1])) or ranked(*a))
    return made


def test_two_passes_make_all_picks(members, monkeypatch):
    made = passes(monkeypatch)
    selection.representatives(members, 20)
    assert made == [[0, 1, 2], [0, 1]]  # the third cluster has no more than the nearest


def test_a_pool_that_does_not_reach_is_read_again(spark, monkeypatch):
    """Many copies near the centroid fill the pool, but only the first of them is worth a pick."""
    rng = np.random.default_rng(3)
    near = [[10.0, 0.1, 0.0, 0.0]] * 60
    far = [[5.0, *(float(v) for v in rng.normal(size=3) * 4)] for _ in range(12)]
    df = spark.createDataFrame([(i, i % 1, v) for i, v in enumerate(near + far)],
                               "review_id bigint, cluster_id int, embedding array<float>").repartition(3)
    made = passes(monkeypatch)
    got = by_cluster(selection.mmr_per_cluster(df, df.where(F.lit(False)), 6, pool=4))
    assert got == brute_force(df, 0, 6)
    assert 3 < len(made) <= 7


@pytest.mark.parametrize("lam", [0.0, 0.3, 1.0])
def test_any_weight_of_the_centroid(members, lam):
    got = selection.representatives(members, 8, 3, lam)
    assert by_cluster(got) == brute_force(members, 3, 5, lam)


def test_picks_do_not_depend_on_partitioning(members):
    one = by_cluster(selection.representatives(members.coalesce(1)))
    many = by_cluster(selection.representatives(members.repartition(13)))
    assert one == many


def test_equal_vectors_are_picked_by_id(spark):
    rows = [(i, 0, [1.0, 0.0]) for i in range(9, -1, -1)]
    df = spark.createDataFrame(rows, "review_id bigint, cluster_id int, embedding array<float>")
    assert by_cluster(selection.representatives(df))[0] == list(range(10))


def test_centroids(members):
    got = {r["cluster_id"]: r for r in selection.cluster_centroids(members).collect()}
    frame = members.toPandas()
    for cid, part in frame.groupby("cluster_id"):
        assert got[cid]["size"] == len(part)
        assert np.allclose(got[cid]["centroid"], np.stack(part["embedding"]).mean(axis=0), atol=1e-6)


def test_no_pairs_are_built(members):
    plan = plan_of(selection.nearest_per_cluster(members, 5))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("WindowGroupLimit") == 4


def test_members_without_a_vector_are_near_to_nothing(spark, members):
    missing = spark.createDataFrame([(900, 0, None), (901, 7, None)], members.schema)
    more = members.unionByName(missing)
    assert by_cluster(selection.representatives(more)) == by_cluster(selection.representatives(members))
    assert by_cluster(selection.negative_sample(more, 13, 4))[7] == [901]


def test_empty_input(members):
    none = members.where(F.lit(False))
    assert selection.representatives(none).collect() == []
    assert selection.negative_sample(none).collect() == []
