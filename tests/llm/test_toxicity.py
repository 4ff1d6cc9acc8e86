import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import toxicity
from reviewmill.llm.queries import QUERIES, TOXIC_FOLDS, TOXIC_HELD_OUT, held_out

MILD = "river stone green walking under early light seven paper window gentle market".split()


def made_up(rng, n, stem="grobz"):
    """Texts of mild words; the toxic ones hold, anywhere, a few words of one stem, each with another ending."""
    rows = []
    for i in range(n):
        words = [MILD[j] for j in rng.integers(0, len(MILD), int(rng.integers(20, 160)))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(int(rng.integers(0, len(words))), stem + "".join(rng.choice(list("aeioukl"), 4)))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = made_up(np.random.default_rng(3), 400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 250], "doc_id bigint, toxic int")
    return rows, docs, labels, toxicity.train(docs, labels)


def test_learns_words_never_seen_from_their_characters(learned):
    rows, docs, _, model = learned
    scores = {r["key"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    unseen = [r for r in rows if r[0] >= 250]
    right = sum((scores[r[0]] >= 0.5) == bool(r[2]) for r in unseen)
    assert right >= 0.95 * len(unseen)


def test_a_word_far_inside_a_long_text_counts(spark, learned):
    model = learned[3]
    rng = np.random.default_rng(5)
    clean = [MILD[j] for j in rng.integers(0, len(MILD), 30_000)]
    dirty = list(clean)
    dirty[22_000:22_000] = ["grobzaeki", "grobzoulk", "grobzlaie"]
    docs = spark.createDataFrame([(1, " ".join(clean)), (2, " ".join(dirty))], "doc_id bigint, text string")
    found = {r["key"]: r for r in toxicity.scored(docs, model).collect()}
    assert found[1]["score"] < 0.5 <= found[2]["score"]
    assert found[2]["window"] <= 22_002 < found[2]["window"] + toxicity.WINDOW + 2


def test_windows_hold_every_word():
    for n in (0, 1, 16, 17, 31, 32, 33, 48, 49, 500):
        starts = list(toxicity.window_starts(n))
        covered = {w for s in starts for w in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and len(starts) <= max(1, n)


def test_gradients_agree_with_differences():
    random = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in toxicity._new_parameters(5, random).items()}
    sent = random.normal(size=(2, 9, 3 * toxicity.HIDDEN))
    ids, mask = random.integers(0, 9, (3, 6)), np.ones((3, 6), bool)
    mask[1, 4:] = mask[2, 1:] = False
    error = random.normal(size=3)

    def loss():
        return float(error @ toxicity._forward(p, sent, ids, mask, keep=True)[0])

    global_states = toxicity._forward(p, sent, ids, mask, keep=True)[1]
    grad, d_sent = toxicity._backward(p, global_states, error)
    for name in ("across", "look", "ask", "weigh", "level"):
        for _ in range(4):
            at = tuple(random.integers(0, s) for s in p[name].shape)
            kept = p[name][at]
            p[name][at] = kept + 1e-2
            up = loss()
            p[name][at] = kept - 1e-2
            down = loss()
            p[name][at] = kept
            assert grad[name][at] == pytest.approx((up - down) / 2e-2, rel=3e-2, abs=3e-3)
    for direction in (0, 1):
        total = sum(d_sent[direction, i, t] for i in range(3) for t in range(6) if ids[i, t] == ids[0, 0] and mask[i, t])
        sent[direction, ids[0, 0], 3] += 1e-2
        up = loss()
        sent[direction, ids[0, 0], 3] -= 2e-2
        down = loss()
        sent[direction, ids[0, 0], 3] += 1e-2
        assert total[3] == pytest.approx((up - down) / 2e-2, rel=3e-2, abs=3e-3)


def test_hard_rows(spark, hard, nothing, learned):
    model = learned[3]
    rows = toxicity.scored(hard, model).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_key = {r["key"]: r for r in rows}
    for key in (1, 2, 3, 8):  # null, empty, blank, no letter
        assert by_key[key]["score"] == model.share and by_key[key]["window"] is None
    assert toxicity.scored(nothing, model).collect() == []
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(hard, empty) == toxicity.Toxicity(0.0)
    one = spark.createDataFrame([(4, 1), (5, None), (None, 1)], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.scored(hard, toxicity.train(hard, one)).collect()} == {1.0}
    unmatched = spark.createDataFrame([(-4, 1), (-5, 0)], "doc_id bigint, toxic int")
    assert toxicity.train(hard, unmatched).share == 0.5
    both = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (9, 0), (6, 0)], "doc_id bigint, toxic int")
    assert toxicity.train(hard, both).share == 0.25


def test_repeatable_under_any_partitioning(learned):
    _, docs, labels, model = learned
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert (again.slope, again.offset) == (model.slope, model.offset)
    assert all((again.parameters[k] == model.parameters[k]).all() for k in model.parameters)


def test_query_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.1"  # some 350 toxic rows to learn from; a tenth of that is too few
    rows = QUERIES["op11_toxicity"](spark, folder)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    told = rows.join(labels, "doc_id").collect()
    rows.persist()
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    fold = held_out(folds=TOXIC_FOLDS, fold=TOXIC_HELD_OUT)
    assert rows.where(F.col("held_out") != fold).count() == 0
    clean = [r for r in told if r["held_out"] and not r["toxic"]]
    toxic = [r for r in told if r["held_out"] and r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.8 * len(toxic)
    above = np.mean([[t["score"] > c["score"] for c in clean] for t in toxic])
    assert above >= 0.93
