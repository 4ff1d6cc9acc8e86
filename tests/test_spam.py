import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.plans import plan_of
from reviewmill.operators import spam

PROTOTYPES = (["p0", "p1", "n0"], np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]), 2)


@pytest.fixture(scope="module")
def data(spark, rng):
    x = rng.normal(size=(200, 3)).astype(np.float32)
    texts = ["visit www.x.com" if i % 50 == 0 else "fine" for i in range(200)]
    rows = [(i, texts[i], [float(v) for v in x[i]]) for i in range(200)]
    df = spark.createDataFrame(rows, "review_id bigint, text string, embedding array<float>")
    return x.astype(float), df


def expected(x, ratio=0.06, floor=0.32, gap=0.03):
    sims = x / np.linalg.norm(x, axis=1, keepdims=True)
    pos, neg = sims[:, :2].max(1), sims[:, 2]
    threshold = max(np.quantile(pos, 1 - ratio), floor)
    url = np.arange(len(x)) % 50 == 0
    return threshold, ((pos >= threshold) & (pos - neg >= gap)) | url, pos, neg, url


def test_flags_follow_the_rule(data):
    x, df = data
    flags, threshold = spam.detect_spam(df, df, PROTOTYPES)
    want_threshold, want, pos, neg, url = expected(x)
    assert threshold == pytest.approx(want_threshold)
    rows = flags.orderBy("review_id").collect()
    assert [r["is_spam"] for r in rows] == want.tolist()
    for i, r in enumerate(rows):
        assert r["sim_pos"] == pytest.approx(pos[i], abs=6e-5)
        assert r["spam_score"] == pytest.approx(pos[i] - neg[i] + 0.1 * url[i], abs=6e-5)
        assert r["matched_prototype"] == ("p0" if x[i, 0] >= x[i, 1] else "p1")


def test_wide_rows_score_the_same_without_a_join(data):
    _, df = data
    wide = spam.score_rows(df, PROTOTYPES)
    narrow = spam.spam_scores(df, df, PROTOTYPES)
    cols = ["review_id", "sim_pos", "sim_neg", "matched_prototype", "has_url"]
    assert sorted(wide.select(cols).collect()) == sorted(narrow.select(cols).collect())
    plan = plan_of(wide)
    assert "Exchange" not in plan and "Join" not in plan


def test_only_ids_and_flags_cross_the_join(spark, folder):
    from reviewmill.plans.standin import Tables

    t = Tables(spark, folder)
    scores = spam.spam_scores(t.read("documents").withColumnRenamed("doc_id", "review_id"),
                              t.vectors, t.prototypes)
    plan = plan_of(scores)
    shuffled = [l for l in plan.splitlines() if "Exchange" in l]
    assert shuffled and "CartesianProduct" not in plan


def test_a_url_alone_is_enough_and_the_boost_decides_nothing(spark):
    rows = [(1, 0.1, 0.9, True), (2, 0.5, 0.45, False), (3, 0.5, 0.48, False), (4, 0.39, 0.1, False)]
    scores = spark.createDataFrame(
        rows, "review_id bigint, sim_pos double, sim_neg double, has_url boolean"
    ).withColumn("matched_prototype", F.lit("p"))
    got = {r["review_id"]: r["is_spam"] for r in spam.flag(scores, 0.4).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_threshold_has_a_floor_and_an_empty_default(spark):
    low = spark.createDataFrame([(0.1,), (0.2,)], "sim_pos double")
    assert spam.positive_threshold(low) == 0.32
    assert spam.positive_threshold(low.limit(0)) == 1.0


def test_overrides_candidates_and_active(spark):
    flags = spark.createDataFrame(
        [(1, True, 0.5, "p"), (2, True, 0.7, "p"), (3, False, 0.1, "p")],
        "review_id bigint, is_spam boolean, spam_score double, matched_prototype string")
    reviews = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d")], "review_id bigint, text string")
    cleared = spark.createDataFrame([(1,), (1,), (9,)], "review_id bigint")
    after = spam.override_flags(flags, cleared)
    assert {r["review_id"]: r["is_spam"] for r in after.collect()} == {1: False, 2: True, 3: False}
    assert [tuple(r) for r in spam.spam_candidates(flags, reviews).collect()] == [
        (2, 0.7, "p", ""), (1, 0.5, "p", "a")]
    active = spam.active_reviews(reviews, flags)
    assert {r["review_id"] for r in active.collect()} == {3, 4}


def test_vectors_of_another_width_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "review_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="differ in width|reshape"):
        spam.prototype_similarities(df, PROTOTYPES).collect()
