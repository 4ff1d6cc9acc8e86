import math
import random
from collections import Counter

import pytest

from reviewmill.operators import phrases


def plain_ratio(k, r, c, t):
    cells = [(k, r * c / t), (r - k, r * (t - c) / t), (c - k, (t - r) * c / t), (t - r - c + k, (t - r) * (t - c) / t)]
    return 2 * sum(o * math.log(o / e) for o, e in cells if o)


def texts_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)


def test_planted_phrases_in_two_languages(spark):
    chance = random.Random(2)
    common = ["boss", "map", "sound", "level", "quest", "그래픽", "사운드", "스토리", "friend", "server"]
    texts = []
    for i in range(300):
        words = chance.choices(common, k=12)
        if i % 9 == 0:
            words[4:6] = ["frame", "rate"]
        if i % 10 == 0:
            words[8:10] = ["최적화", "문제"]
        texts.append(" ".join(words) + "!")
    texts += [None, "", "alone", "of the of the of the of the of the"]
    found = {(r["first"], r["second"]): r for r in phrases.phrases(texts_of(spark, texts), ["of", "the"]).collect()}
    assert {("frame", "rate"), ("최적화", "문제")} == {p for p, r in found.items() if r["ratio"] > 60}
    assert not any("of" in p for p in found)
    pairs = Counter(p for t in texts if t for w in [t.rstrip("!").split()] for p in zip(w, w[1:]))
    first, second = Counter(), Counter()
    for (a, b), n in pairs.items():
        first[a] += n
        second[b] += n
    for (a, b), r in found.items():
        assert r["n"] == pairs[a, b]
        assert r["ratio"] == pytest.approx(plain_ratio(pairs[a, b], first[a], second[b], sum(pairs.values())))


def test_pairs_by_chance_and_empty_texts_are_no_phrases(spark):
    chance = random.Random(5)
    even = [" ".join(chance.choices("abcdefgh", k=40)).replace(" ", "x ") for _ in range(60)]
    assert phrases.phrases(texts_of(spark, even)).count() <= 2
    assert phrases.phrases(texts_of(spark, [None, "", "one"])).collect() == []


def test_particles_leave_the_words(spark):
    nouns = "게임 그래픽 스토리 사운드 캐릭터 난이도 최적화 서버 무기 보스".split()
    endings = ["", "이", "은", "는", "을", "에서", "에서는", "까지"]
    words = [n + e for n in nouns for e in endings] + ["어제", "game", "games", "바다"]
    found = {r["word"]: (r["stem"], r["ending"]) for r in phrases.stems(
        spark.createDataFrame([(w,) for w in words * 3], "word string")).collect()}
    for noun in nouns:
        for ending in endings[1:]:
            assert found[noun + ending] == (noun, ending)
        assert noun not in found
    assert not {"어제", "game", "games", "바다"} & set(found)
    assert phrases.stems(spark.createDataFrame([], "word string")).collect() == []
