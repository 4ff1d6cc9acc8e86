import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from reviewmill.llm import simhash
from reviewmill.llm.components import connected
from reviewmill.llm.queries import op1_simhash


def plain_print(text, shingle=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    runs = [words[i: i + shingle] for i in range(len(words) - shingle + 1)] or [words]
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, radius=4):
    prints = np.array(prints, np.uint64)
    root = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    while True:
        lower = np.where(near, root[None, :], len(prints)).min(1)
        if (lower == root).all():
            return root
        root = lower


def test_query_equals_brute_force(spark, folder, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    prints = [plain_print(t) for _, t in rows]
    roots = plain_roots(prints)
    expected = {(d, f"{p:016x}", rows[roots[i]][0]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))}
    got = {tuple(r) for r in op1_simhash(spark, folder).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == expected


def test_hard_rows(hard, nothing):
    got = simhash.near_copies(hard).collect()
    assert len(got) == hard.count()
    by_key = {}
    for r in got:
        by_key.setdefault(r.key, []).append(r)
    assert [r.print for k in (1, 2, 3) for r in by_key[k]] == [0, 0, 0]
    assert {r.component for k in (1, 2, 3) for r in by_key[k]} == {1}
    assert {r.component for r in by_key[9] + by_key[10]} == {9} and len(by_key[9]) == 2
    assert by_key[6][0].component == by_key[7][0].component == 6
    assert {r.component for r in by_key[None]} == {1, None}
    assert simhash.near_copies(nothing).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97} x{i % 13}" for i in range(5000))
    whole = simhash._fingerprint(text.encode(), 4)
    monkeypatch.setattr(simhash, "PIECE_BYTES", 100)
    assert simhash._fingerprint(text.encode(), 4) == whole == plain_print(text)


def test_masks_cover_every_pair_within_the_radius():
    draw = random.Random(3)
    for fixed in (0, (1 << 32) - 1, (1 << 52) - 1):
        masks = simhash.covering_masks(fixed, 4)
        free = [b for b in range(64) if not fixed >> b & 1]
        assert len(masks) == 31 and all(m != fixed for m in masks)
        for _ in range(2000):
            other = sum(1 << b for b in draw.sample(free, draw.randint(1, 4)))
            assert any(not m & other for m in masks)


def test_large_buckets_lose_no_link(spark):
    draw = random.Random(5)
    center = draw.getrandbits(64)
    prints = {center}
    while len(prints) < 3000:
        prints.add(center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 7))))
    prints |= {draw.getrandbits(64) for _ in range(500)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "print bigint")
    roots = connected(simhash.near_links(frame, bucket_rows=256), "a", "b")
    got = {r.node: r.root for r in roots.collect()}
    expected = plain_roots([p & (1 << 64) - 1 for p in signed])
    assert [got.get(p, p) for p in signed] == [signed[i] for i in expected]


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    more = spark.createDataFrame([(900, 901), (901, 900), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected(links.unionByName(more), "a", "b").collect()}
    assert got == {i: 0 for i in range(200)} | {900: 900, 901: 900}
    assert connected(links.where("a < 0"), "a", "b").count() == 0
