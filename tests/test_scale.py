import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.plans import plan_of
from reviewmill.operators import scale, views


@pytest.fixture(scope="module")
def numbers(spark, rng):
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.normal(size=500) * 9])
    return values, spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)


@pytest.mark.parametrize("q", [0.0, 0.001, 0.37, 0.5, 0.94, 0.99999, 1.0])
def test_quantile_is_exact(numbers, q):
    values, df = numbers
    assert scale.exact_quantile(df, "v", q) == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_quantile_of_constants_and_of_nothing(spark):
    same = spark.createDataFrame([(1.5,)] * 9 + [(None,)], "v double")
    assert scale.exact_quantile(same, "v", 0.94) == 1.5
    assert scale.exact_quantile(same.where("v > 2"), "v", 0.94) is None


def test_order_statistics_bring_few_rows_to_the_driver(numbers, monkeypatch):
    values, df = numbers
    ranked, brought = np.sort(values), []
    plain = scale._pass_over
    monkeypatch.setattr(scale, "_pass_over", lambda frame: brought.append(plain(frame)) or brought[-1])
    for rank in (0, 1, 2799, 5499):
        assert scale.exact_rank_value(df, "v", rank) == ranked[rank]
    assert max(map(len, brought)) < 20


def test_pages_cut_one_order_whatever_their_depth(spark):
    rows = [(i // 3 * 7 if i % 11 else None, f"t{i % 5}") for i in range(1000)]
    df = spark.createDataFrame(rows, "review_id bigint, text string").repartition(4)
    pages = [views.page(df, n, 60).collect() for n in range(1, 19)]
    assert [len(p) for p in pages] == [60] * 16 + [40, 0]
    got = [tuple(r) for p in pages for r in p]
    assert sorted(got, key=str) == sorted(rows, key=str)
    ids = [r[0] for r in got]
    assert ids == sorted((i for i in ids if i is not None)) + [None] * ids.count(None)
    assert [views.page(df.repartition(7), n, 60).collect() for n in (1, 9, 16, 17)] == [pages[n - 1] for n in (1, 9, 16, 17)]


def test_page_count_is_at_least_one(spark):
    assert views.page_count(spark.range(101)).first()["max_page"] == 3
    assert tuple(views.page_count(spark.range(0)).first()) == (0, 1)


def test_sample_has_exact_size_and_ignores_partitioning(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "review_id")
    first = scale.uniform_sample(ids.repartition(3), 500, 42)
    again = scale.uniform_sample(ids.repartition(11), 500, 42)
    a, b = ({r[0] for r in s.collect()} for s in (first, again))
    assert len(a) == 500 and a == b
    full_sort = ids.orderBy(scale._hash_rank(F.col("review_id"), 42), "review_id").limit(500)
    assert a == {r[0] for r in full_sort.collect()}
    assert a != {r[0] for r in scale.uniform_sample(ids, 500, 43).collect()}
    assert scale.uniform_sample(ids.limit(7), 500, 42).count() == 7


def test_top_n_limits_before_it_shuffles(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(4)
    best = scale.top_n_per_group(df, ["k"], [F.desc("v")], 2)
    assert plan_of(best).count("WindowGroupLimit") == 4
    assert sorted(map(tuple, best.collect())) == [
        (0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)]


def test_pin_evaluates_once_into_a_written_table(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pinned = scale.pin(spark.range(50).mapInArrow(count, "id long"))
    assert "FileScan parquet" in plan_of(pinned) and pinned.count() == pinned.count() == 50
    assert seen.value == 50


@pytest.mark.parametrize("q", [0.0, 0.06, 0.25, 0.5, 0.94, 0.999, 1.0])
@pytest.mark.parametrize("case", ["spread", "ties", "few", "missing", "narrow"])
def test_quantile_in_two_passes(spark, rng, monkeypatch, q, case):
    made = []
    plain = scale._pass_over
    monkeypatch.setattr(scale, "_pass_over", lambda frame: made.append(1) or plain(frame))
    values = {
        "spread": rng.normal(size=3000).tolist() + [float("inf"), -1e300],
        "ties": [0.25] * 2000 + [0.5] * 900 + [0.75],
        "few": [3.0, 1.0],
        "missing": [None, *rng.normal(size=500).tolist(), None, None],
        "narrow": rng.normal(size=3000).tolist(),
    }[case]
    if case == "narrow":  # brackets of a few values: sketches follow sketches
        monkeypatch.setattr(scale, "BRACKET_ROWS", 60)
        monkeypatch.setattr(scale, "SKETCH_STEPS", 40)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    known = [v for v in values if v is not None]
    got = scale.exact_quantile(df, "x", q)
    want = duckdb.execute(f"SELECT quantile_cont(x, {q}) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [known]).fetchall()[0][0]
    assert got == pytest.approx(want, rel=1e-15) or (got == want)
    assert len(made) == 2 or case == "narrow" and 2 < len(made) <= 5


def test_not_a_number_is_the_largest(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0,), (2.0,), (nan,), (None,), (nan,)], "x double")
    assert scale.exact_quantile(df, "x", 0.0) == 1.0
    assert scale.exact_quantile(df, "x", 1 / 3) == 2.0
    for q in (0.5, 1.0):
        assert np.isnan(scale.exact_quantile(df, "x", q))
    assert scale.exact_quantile(df.limit(0), "x", 0.5) is None
    assert scale.exact_quantile(df.where("x IS NULL"), "x", 0.5) is None


def test_rank_of_large_whole_numbers(spark):
    base = 2**62
    ids = [base + 7 * i for i in range(400)] + [-base, 0]
    df = spark.createDataFrame([(i,) for i in ids], "x bigint").repartition(3)
    for rank in (0, 1, 2, 250, 401):
        assert scale.exact_rank_value(df, "x", rank) == sorted(ids)[rank]
    assert scale.exact_rank_value(df, "x", 402) is None
