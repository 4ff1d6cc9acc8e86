import re

import numpy as np

from reviewmill.llm import mixing
from reviewmill.llm.queries import op3_mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, limits, and the excess dealt again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return target | share
        target |= {s: float(most * sizes[s]) for s in above}
        left -= sum(most * sizes[s] for s in above)
        free -= above
    return target


def test_query_against_plain_targets(spark, folder, documents):
    texts = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in documents.collect()}
    sizes = {}
    for source, n in texts.values():
        sizes[source] = sizes.get(source, 0) + n
    expected = plain_targets(sizes)
    rows = op3_mixing(spark, folder).collect()
    assert {r.doc_id: r.size for r in rows} == {d: n for d, (_, n) in texts.items()} and len(rows) == len(texts)
    taken = {}
    for r in rows:
        source = texts[r.doc_id][0]
        assert r.source_size == sizes[source] and abs(r.target - expected[source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for source, n in taken.items():
        assert abs(n - expected[source]) <= max(mixing.BLOCK_WORDS * 2, 0.02 * expected[source])
    again = op3_mixing(spark, folder).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_targets_with_limits(spark):
    for sizes in ({"a": 1, "b": 100, "c": 1000, None: 7}, {"a": 0, "b": 0}, {"x": 5}, {"a": 10, "b": 10, "c": 10, "d": 10_000}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        expected = plain_targets(sizes)
        assert all(abs(got[s] - expected[s]) < 1e-9 * (1 + expected[s]) for s in sizes)


def test_contents_hold_each_block_as_often_as_drawn(hard):
    mixture = mixing.mix(hard, shard_slots=100)
    slots = mixture.slots.toPandas()
    sources = {r.source_no: r for r in mixture.sources.collect()}
    for number, own in slots.groupby("source_no"):
        assert len(own) == sources[number].quota
        uses = own.groupby(["epoch", "block"]).size()
        assert (uses == 1).all() and own.block.between(0, sources[number].blocks - 1).all()
        full = own.groupby("epoch").size().iloc[:-1]
        assert (full == sources[number].blocks).all()
    words = mixture.contents().groupBy("shard").sum("words").count()
    assert words == slots.shard.nunique()


def test_hard_rows(hard, nothing):
    rows = mixing.mix(hard).taken().collect()
    assert len(rows) == hard.count()
    assert all(r.size == r.taken == 0 for r in rows if r.key in (1, 2, 3))
    assert [r.size for r in rows if r.key == 9] == [7, 7]
    assert mixing.mix(nothing).taken().count() == 0
    texts = mixing.mixed_texts(hard, mixing.mix(hard)).collect()
    assert sum(len(r.text.split()) for r in texts) == sum(r.taken for r in rows)
    assert mixing.mixed_texts(nothing, mixing.mix(nothing)).columns == nothing.columns


def test_partitioning_changes_nothing(documents):
    once, again = (sorted(map(tuple, mixing.mix(documents.repartition(n)).taken().collect())) for n in (1, 6))
    assert once == again


def test_permutation():
    for n in (1, 2, 3, 10, 64, 1000):
        image = mixing.permuted(np.arange(n), n, (1, 2, 3))
        assert sorted(image.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, (1, 2, 3)).tolist() != mixing.permuted(np.arange(1000), 1000, (1, 2, 4)).tolist()
