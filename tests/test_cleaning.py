
import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from reviewmill import constants as C
from reviewmill.functions import text as X
from reviewmill.operators import cleaning, evaluation
from pyspark.sql import functions as F


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "review_id bigint, text string")


def weight(ch):
    """What one character adds to the score of its text."""
    total = 0
    if "가" <= ch <= "힣" or (ch.isascii() and ch.isalpha()):
        total += 1
    if ch in C.MOJIBAKE_CHARS:
        total -= 3
    if not (ch.isalnum() or ch.isspace() or ch == "_" or ch in ".,!?'\"()-:;/&%$#@*+="):
        total -= 1
    return total


def score(text):
    return sum(map(weight, text)) / len(text) if text else -1.0


def repaired(text):
    try:
        other = bytes(map(ord, text)).decode()
    except ValueError:
        return text
    return max((text, other), key=score)


MOJIBAKE = "그래픽".encode().decode("latin-1")
CASES = [
    (MOJIBAKE, "그래픽"),
    ("plain ascii", "plain ascii"),
    ("한국어", "한국어"),
    ("café", "café"),
    (MOJIBAKE + "😀", MOJIBAKE + "😀"),
    ("", ""),
    ("naïve Â° text", "naïve Â° text"),
]


def test_repair_cases(spark):
    rows = cleaning.repair(frame(spark, [c[0] for c in CASES])).orderBy("review_id").collect()
    assert [r["text"] for r in rows] == [c[1] for c in CASES]
    assert [r["was_repaired"] for r in rows] == [a != b for a, b in CASES]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=20, max_size=40))
def test_repair_and_score_follow_the_definition(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    texts += [t.encode("utf-8", "ignore").decode("latin-1") for t in texts]
    # the JVM and Python know different Unicode versions: keep to characters known to both
    texts = [t for t in texts if all(unicodedata.ucd_3_2_0.category(c) != "Cn" for c in t)]
    rows = cleaning.repair(frame(spark, texts)).withColumn(
        "score", X.intactness(F.col("original_text"))
    ).orderBy("review_id").collect()
    for text, row in zip(texts, rows):
        assert row["score"] == pytest.approx(score(text)), repr(text)
        assert row["text"] == repaired(text), repr(text)


def test_damage_then_repair_is_identity(spark):
    texts = ["그래픽이 정말 좋다", "Très réussi", "plain", "日本語"]
    damaged = evaluation.inject_mojibake(frame(spark, texts), 1)
    assert [r["text"] for r in cleaning.repair(damaged).orderBy("review_id").collect()] == texts


def test_blank_rows_go_and_null_counts_as_blank(spark):
    texts = [None, "", "   ", "\t\n\x0b\x1c\x85  　", "x", "​"]
    df = frame(spark, texts)
    assert [r["review_id"] for r in cleaning.clean(df).collect()] == [4, 5]
    stats = cleaning.clean_stats(df).first()
    assert (stats["input_count"], stats["output_count"], stats["encoding_repaired"]) == (6, 2, 0)
    sent = df.select(X.embeddable(F.col("text")).alias("t")).collect()
    assert [r["t"] for r in sent][:5] == [" ", " ", " ", " ", "x"]


def test_strip_trims_what_python_strips(spark):
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    df = frame(spark, [c + "a" + c for c in spaces])
    assert {r["t"] for r in df.select(X.strip(F.col("text")).alias("t")).collect()} == {"a"}


@pytest.mark.parametrize("text, expected", [
    ("see HTTP://x", True), ("www.a", True), ("great.cool", True), ("BIT.LY/x", True),
    ("buy at my-site.com now", True), ("site.comé", False), ("site.community", False),
    (".com", False), ("a.io_", False), ("a.io-", True), ("nothing here. At all", False),
    ("TinyURL", True), ("", False),
])
def test_url_marker(spark, text, expected):
    pattern = re.compile(C.URL_PATTERN, re.IGNORECASE)
    assert bool(pattern.search(text)) is expected
    assert frame(spark, [text]).select(X.has_url(F.col("text"))).first()[0] is expected


def test_url_marker_is_linear_in_long_words(spark):
    import time

    df = frame(spark, ["a" * 300_000])
    start = time.time()
    assert df.select(X.has_url(F.col("text"))).first()[0] is False
    assert time.time() - start < 20


def test_clip(spark):
    df = frame(spark, ["  a\nb  ", "x" * 12, None])
    got = [r[0] for r in df.orderBy("review_id").select(X.clip(F.col("text"), 10)).collect()]
    assert got == ["a b", "x" * 10 + "…", ""]
    bare = df.orderBy("review_id").select(X.clip(F.col("text"), 10, ellipsis=False)).collect()
    assert [r[0] for r in bare] == ["a b", "x" * 10, ""]


def test_repair_examples_are_capped_and_short(spark):
    long = ("그래픽" * 60).encode().decode("latin-1")
    rows = cleaning.repair_examples(frame(spark, [long] * 7)).collect()
    assert [r["review_id"] for r in rows] == [0, 1, 2, 3, 4]
    assert all(len(r["before"]) == len(r["after"]) == 120 for r in rows)
