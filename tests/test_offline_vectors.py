"""The offline vectors against a plain computation: hashed words, inverse document frequency, unit length."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from reviewmill.operators import embedding


def murmur3(data: bytes, seed: int = 42) -> int:
    """The 32-bit hash of the public algorithm, signed."""
    def mixed(k):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        return k * 0x1B873593 & 0xFFFFFFFF

    h, whole = seed, len(data) // 4 * 4
    for at in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[at : at + 4], "little"))
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    if len(data) > whole:
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_murmur3_of_known_values():
    assert [murmur3(b"", 0), murmur3(b"hello", 0), murmur3(b"test", 0x9747B28C) & 0xFFFFFFFF] == [0, 613153351, 0x704B81DC]


@pytest.mark.parametrize("width", [16, 256])
def test_vectors_are_those_of_the_definition(spark, width):
    texts = ["Good game, good story", "bad BUGS and crashes", "게임 good 게임이", "good", "one two three four five", "crashes!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "review_id bigint, text string").repartition(3)
    model = embedding.fit_offline_embedder(rows, width)
    got = {r["review_id"]: np.array(r["embedding"]) for r in embedding.embed_offline(model, rows).collect()}
    bags = [Counter(murmur3(w.encode()) % width for w in re.split(r"[^\w]+|_", t.lower()) if w) for t in texts]
    held = Counter(place for bag in bags for place in bag)
    for i, bag in enumerate(bags):
        want = np.zeros(width)
        for place, n in bag.items():
            want[place] = n * math.log((len(texts) + 1) / (held[place] + 1))
        length = np.linalg.norm(want)
        assert got[i] == pytest.approx(want / length if length else want, abs=1e-6)
