import math

import numpy as np
from pyspark.sql import functions as F

from reviewmill.llm import neighbours
from reviewmill.llm.queries import op7_neighbours


def plain(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in good:
        if asked(q):
            near = sorted((math.dist(x, y), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out |= {(q, rank, i) for rank, (_, i) in enumerate(near, 1)}
    return out


def test_query_equals_brute_force(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = op7_neighbours(spark, folder).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == plain(rows, lambda q: q % 100 == 0, 10)
    vectors = dict(rows)
    assert all(abs(r.score - math.dist(vectors[r.query_id], vectors[r.vec_id])) < 1e-12 for r in got)


def test_hard_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(300)]
    rows += [(300, None), (400, []), (500, [0.0] * 5), (600, [1.0, None, 1.0, 1.0, 1.0]), (700, [float("nan")] * 5),
             (800, [float("inf")] * 5), (None, [1.0] * 5), (900, [1.0, 2.0]), (901, [1.0, 3.0]), (1000, [1e-320] * 5), (1001, [1e150] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("group", F.lit(1)).repartition(4)
    for blocks in ({}, {"query_rows": 2, "block_rows": 7}):
        got = neighbours.nearest(frame, F.col("vec_id") % 100 == 0, 10, **blocks).collect()
        assert {(r.query_id, r.rank, r.vec_id) for r in got} == plain(rows, lambda q: q % 100 == 0, 10)
    assert {r.vec_id for r in got if r.query_id == 900} == {901}
    assert neighbours.nearest(frame.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_rows_are_candidates_each(spark):
    frame = spark.createDataFrame([(0, [0.0, 1.0])] * 2 + [(1, [0.0, 2.0])] * 3 + [(2, [0.0, 9.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("vec_id") == 0, 4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 1, 1, 2]


def test_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=2500).tolist()) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(frame, F.col("vec_id") < 5, 3).collect()}
    assert got == plain(rows, lambda q: q < 5, 3)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(20, 64)), rng.normal(size=(500, 64))
    tile = neighbours._Tile(5)
    sides = []
    for ids, m in ((np.arange(20), x), (np.arange(100, 600), y)):
        packed = neighbours._packed(64, 0, ids, m).to_pylist()[0]
        sides.append(tile._side(packed, ""))
    query, other = tile._survivors(*sides)
    assert len(query) < 20 * 500 / 4
    near = {(q, v) for q in range(20) for v in np.argsort(((x[q] - y) ** 2).sum(1))[:5].tolist()}
    assert near <= set(zip(query.tolist(), other.tolist(), strict=True))


def test_queries_are_neither_copied_nor_joined(spark):
    """A copy of the queries for each group of vectors, which Spark took for small, was sent to the driver."""
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    plan = neighbours.nearest(frame, F.col("vec_id") % 100 == 0, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_single_precision_loses_no_pair():
    rng = np.random.default_rng(11)
    for width, scale in ((3, 1.0), (64, 1e-3), (64, 1e6), (1500, 1.0)):
        x, y = rng.normal(size=(30, width)) * scale, rng.normal(size=(400, width)) * scale * rng.choice([1, 1e-4, 30], (400, 1))
        y[:60] = x.repeat(2, 0) * (1 + 1e-6)
        distances = np.sqrt(((x[:, None] - y) ** 2).sum(2))
        tile = neighbours._Tile(5)
        asked = tile._side(neighbours._packed(width, 0, np.arange(30), x).to_pylist()[0], "")
        among = tile._side(neighbours._packed(width, 0, np.arange(100, 500), y).to_pylist()[0], "")
        right = neighbours._Right(among, float(np.median(among[3])))
        for limit in (distances.min(1), np.sort(distances, 1)[:, 4], distances.max(1)):
            left = tile._left(asked, limit, float(np.median(among[3])))
            found = set(zip(*(a.tolist() for a in tile._reached(asked, left, right)), strict=True))
            assert set(zip(*(a.tolist() for a in np.nonzero(distances <= limit[:, None])), strict=True)) <= found
        some = tile._reached(asked, tile._left(asked, np.sort(distances, 1)[:, 4], float(np.median(among[3]))), right)
        assert len(some[0]) < distances.size / 2
    assert tile._left(asked, np.full(30, np.inf), 1.0) is None


def test_a_task_that_holds_few_vectors_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=6 if i % 7 else 4).round(1).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[20][1]) for i in range(50)] + [(20, rows[20][1]), (60, [1e200] * 6), (61, [1e-200] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = frame.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    files = neighbours.stored(neighbours.blocks_of(asked.repartition(5, "vec_id"), "vec_id", "embedding", 16), "queries").inputFiles()
    batches = frame.toArrow().to_batches(100)
    expected = plain([r for r in rows if r[0] != 60 or len(r[1]) != 6], lambda q: q % 20 == 0 and q != 60, 4)
    for held, scored in ((1 << 25, 1 << 24), (4000, 500)):
        monkeypatch.setattr(neighbours, "HELD_BYTES", held)
        monkeypatch.setattr(neighbours, "SCORED_BYTES", scored)
        found = [r for b in neighbours._Nearest(files, 4, 16, 32)(iter(batches)) for r in b.to_pylist() if r["query_id"] != 60]
        ranked = {}
        for r in found:
            ranked.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert {(q, i, v) for q, best in ranked.items() for i, (_, v) in enumerate(sorted(best), 1)} == expected


def test_square_is_added_with_one_rounding():
    rng = np.random.default_rng(9)
    total, x = rng.random(1000), rng.normal(size=1000)
    assert neighbours.plus_square(total, x).tolist() == [math.fma(b, b, a) for a, b in zip(total.tolist(), x.tolist(), strict=True)]
