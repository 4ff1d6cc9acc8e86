import numpy as np
import pytest

from reviewmill.llm import whitening
from reviewmill.llm.queries import QUERIES

COLUMNS = "vec_id bigint, embedding array<float>, key string, x string, deviation double"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, v, "k", "x", 0.5) for i, v in enumerate(vectors)], COLUMNS)


def exact(x):
    """Mean, eigenvalues and vectors of the distinct rows in numpy."""
    distinct = np.unique(x, axis=0)
    centred = distinct - distinct.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(distinct))
    return distinct, values[::-1], vectors[:, ::-1]


def check(rows, model, x, keys, k):
    distinct, values, vectors = exact(x)
    assert model.n == len(distinct)
    assert model.eigenvalues == pytest.approx(values[:k], rel=1e-10)
    assert model.trace == pytest.approx(values.sum(), rel=1e-12)
    assert model.identity_error < 1e-9
    white = (x - distinct.mean(axis=0)) @ vectors[:, :k] / np.sqrt(values[:k])
    found = {r["key"]: r for r in rows}
    got = np.array([found[i]["whitened"] for i in keys])
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * signs).max() < 1e-7
    sums = [int(s) for s in distinct.sum(axis=0)]
    for i, row in zip(keys, x):
        assert found[i]["deviation"] == sum((len(distinct) * int(v) - s) ** 2 for v, s in zip(row, sums))


@pytest.mark.parametrize("n, width, decay", [(400, 48, 0.97), (300, 10, 0.8), (90, 120, 0.99), (500, 64, 1.0)])
def test_same_as_a_full_decomposition(spark, n, width, decay):
    random = np.random.default_rng(n)
    vectors = (random.normal(size=(n, width)) * decay ** np.arange(width)).astype(np.float32)
    vectors[5] = vectors[4]
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    rows, model = whitening.whiten(frame(spark, vectors.tolist()).repartition(7))
    check(rows.collect(), model, x, range(n), min(16, width))


def test_rows_that_take_no_part(spark, rng):
    good = rng.normal(size=(40, 5)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [1.0, 1.0, float("-inf"), 0.0, 0.0], [1.0, 2.0]]
    rows, model = whitening.whiten(frame(spark, good).unionByName(frame(spark, bad, 100)))
    found = rows.collect()
    assert sorted(r["key"] for r in found) == list(range(40))
    x = np.floor(64 * np.array(good)).astype(np.int64) + 1_000_000
    check(found, model, x, range(40), 5)
    nameless, _ = whitening.whiten(frame(spark, good).selectExpr("CAST(NULL AS BIGINT) AS vec_id", "embedding"))
    assert nameless.count() == 40


def test_nothing_to_whiten(spark):
    none = spark.createDataFrame([], COLUMNS)
    rows, model = whitening.whiten(none)
    assert rows.collect() == [] and model.n == 0
    rows, model = whitening.whiten(frame(spark, [[1.0, 2.0]] * 3))
    assert model.n == 1 and [list(r["whitened"]) for r in rows.collect()] == [[]] * 3
    rows, model = whitening.whiten(frame(spark, [[1.0, 2.0], [3.0, 2.0], [8.0, 2.0]]))
    assert len(model.eigenvalues) == 1  # the second direction does not vary


def test_a_third_of_all_rows_is_one_vector(spark, rng):
    vectors = rng.normal(size=(60, 6)).astype(np.float32).tolist() + [[0.5] * 6] * 30
    rows, model = whitening.whiten(frame(spark, vectors))
    assert model.n == 61 and rows.count() == 90


def test_deviation_beyond_a_long_is_null(spark):
    model = whitening.Whitening(
        2**30, np.array([2**50] * 3), np.eye(3), np.ones(3), 3.0, np.zeros(3), 0.0)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array([[2**20 + 1] * 3, [2**20 + 2**3] * 3])], names=["key", "x"])
    out = next(whitening._projection(model)([batch]))
    assert out.column("deviation").to_pylist() == [3 * 2**60, None]


def test_uncertified_components_raise():
    random = np.random.default_rng(1)
    noisy = lambda block: block + 1e-3 * random.normal(size=block.shape)
    with pytest.raises(ArithmeticError):
        whitening._leading(noisy, 80, 8, 4, 4, 1, 80.0)


def test_query(spark, folder):
    frame = QUERIES["op12_whitening"](spark, folder)
    rows = frame.collect()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    assert len(rows) == 16 * len(table) and frame.columns[:3] == ["vec_id", "component", "n"]
    x = np.floor(64 * np.array([r["embedding"] for r in table], dtype=np.float64)).astype(np.int64) + 1_000_000
    distinct, values, vectors = exact(x)
    white = (x - distinct.mean(axis=0)) @ vectors[:, :16] / np.sqrt(values[:16])
    at = {r["vec_id"]: i for i, r in enumerate(table)}
    for component in range(1, 17):
        own = [r for r in rows if r["component"] == component]
        got, want = np.array([r["whitened"] for r in own]), np.array([white[at[r["vec_id"]], component - 1] for r in own])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        assert own[0]["explained"] == pytest.approx(values[component - 1] / values.sum(), rel=1e-9)
    assert {r["n"] for r in rows} == {len(distinct)} and all(r["identity_error"] < 1e-9 for r in rows)
