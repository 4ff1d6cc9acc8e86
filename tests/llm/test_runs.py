import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from reviewmill.llm import runs
from reviewmill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, power, least):
    found = []
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j + q - i
                shorter = any(all(words[a] == words[a + r] for a in range(i, i + length - r)) for r in range(1, q))
                if length >= max(least, power * q) and not shorter:
                    found.append((i, length, q))
            i = j + 1
    return sorted(found)


@pytest.mark.parametrize("power, least", [(4, 6), (2, 2), (3, 5), (2, 9), (5, 7)])
def test_same_runs_as_brute_force(power, least):
    chance = random.Random(power * 100 + least)
    texts = []
    for _ in range(600):
        letters, parts = chance.choice([1, 2, 3, 6]), []
        while len(parts) < chance.randrange(1, 70):
            parts += [chance.randrange(letters) for _ in range(chance.randrange(1, 6))] * chance.choice([1, 1, 2, 3, 5])
        texts.append([b"w%d" % x for x in parts])
    for text, found in zip(texts, runs.runs_of(texts, power, least)):
        assert found == brute(text, power, least)


def test_every_square_run_of_a_fibonacci_word():
    before, word = [0], [0, 1]
    while len(word) < 300:
        before, word = word, word + before
    assert runs.all_runs(word) == brute(word, 2, 2)


def test_long_periodic_texts_take_no_square_time():
    one = runs.runs_of([[b"a"] * 200_000])[0]
    assert one == [(0, 200_000, 1)]
    words = [b"%d" % (i * i % 7919) for i in range(5000)] * 8
    assert runs.runs_of([words])[0][0][:2] == (0, 40_000)


def test_hard_rows(hard, nothing):
    rows = runs.periodic_runs(hard).collect()
    assert len(rows) == hard.count()
    plain = {r["key"]: r for r in rows}
    for key in (1, 2, 3):
        assert plain[key]["runs"] == [] and plain[key]["collapsed"] == ""
    assert plain[9]["collapsed"] == "Same text here twice, word for word"
    texts = {r["doc_id"]: r["text"] for r in hard.collect()}
    assert plain[11]["collapsed"] == texts[11]  # only ASCII white space separates words
    assert [tuple(r) for r in plain[6]["runs"]] == brute_spans(texts[6])
    assert runs.periodic_runs(nothing).collect() == []
    assert runs.periodic_runs(hard).columns == ["key", "runs", "collapsed"]


def brute_spans(text):
    return [r for r in runs.runs_of([text.encode().split()])[0]]


def test_ties_and_nested_runs(spark):
    docs = spark.createDataFrame(
        [(1, "a a a a a a x b b b b b b"), (2, "a b a b a b a b a b a b c " * 4), (3, "p q r s")], "doc_id bigint, text string")
    found = {r["key"]: r for r in runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in found[1]["runs"]] == [(0, 6, 1), (7, 6, 1)]
    assert found[1]["collapsed"] == "a x b"
    assert (0, 52, 13) in [tuple(r) for r in found[2]["runs"]] and len(found[2]["runs"]) == 5
    assert found[2]["collapsed"] == "a b c"
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, power=1)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_numbers(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def brute_numbers(words):
    """Brute force by periods, with whole comparisons in numpy to bear long texts."""
    import numpy as np

    numbers = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, int)
    found = []
    for q in range(1, len(words) // 4 + 1):
        same = np.flatnonzero(np.r_[False, numbers[q:] == numbers[:-q], False][1:] != np.r_[False, numbers[q:] == numbers[:-q], False][:-1])
        for start, stop in zip(same[::2].tolist(), same[1::2].tolist()):
            length = stop - start + q
            if length >= max(6, 4 * q) and not any(
                (numbers[start : start + length - r] == numbers[start + r : start + length]).all() for r in range(1, q)
            ):
                found.append((start, length, q))
    return sorted(found)


def test_query_against_brute_force(spark, folder, documents):
    rows = {r["doc_id"]: tuple(r) for r in QUERIES["op13_runs"](spark, folder).collect()}
    assert len(rows) == documents.count()
    texts = documents.where(F.length("text") < 20_000).select("doc_id", "text").collect()
    assert sum(rows[r["doc_id"]][1] > 0 for r in texts) > 10
    for r in texts:
        assert rows[r["doc_id"]] == expected(r["doc_id"], r["text"])
