import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewmill.llm import bpe
from reviewmill.llm.queries import VOCABULARY_FILE, op6_bpe, vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY_FILE))


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(vocabulary())


def test_query_equals_the_library(spark, folder, documents, library):
    expected = set()
    for r in documents.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                      hashlib.sha256(decoded.encode()).hexdigest()))
    assert {tuple(r) for r in op6_bpe(spark, folder).collect()} == expected


def test_odd_texts(library, encoder):
    draw = random.Random(2)
    parts = ["a", "aa", "b", "é", "é", "'s", "'S", "'t", " ", "\n", "　", "\x85", "\x1c", "<|startoftext|>", "<|endoftext|>", "<|", "Σ", "ς",
             "İ", "ǅ", "12", "٣", "²", "!?", "...", "日本", "🙂", "​", "don't", "_", "\x00", "qz", "zq"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_long_words(library, encoder):
    draw = random.Random(4)
    for text in ("a" * 30_000, "".join(draw.choice("abcdefgh") for _ in range(30_000)), "!" * 5000, "é" * 5000):
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_never_crossed_by_a_token(encoder):
    middle, final = encoder.v.inside
    symbols = list("thequickzqxj")
    fragments = encoder.fragments(symbols)
    assert "".join(p for f in fragments for p in f) == "".join(symbols) + encoder.v.end
    for a, b in zip(fragments, fragments[1:], strict=False):
        last = b[0].endswith(encoder.v.end) and len(b) == 1 and b is fragments[-1]
        assert (a[-1], b[0].removesuffix(encoder.v.end)) not in (final if last else middle)
    assert len(fragments) > 1


def test_hard_rows(hard, nothing, library):
    words = vocabulary()
    rows = bpe.decode(bpe.encode(hard, words), words).collect()
    texts = {r.doc_id: r.text or "" for r in hard.collect() if r.doc_id is not None}
    assert len(rows) == hard.count()
    for r in rows:
        if r.key is not None:
            assert r.ids == library.encode(texts[r.key], add_special_tokens=False).ids
            assert r.text == library.decode(r.ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(nothing, words), words).count() == 0


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    encoder = bpe.Encoder(vocabulary())
    text = "one two three four five six one two three"
    assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids and len(encoder.known) <= 3


def test_round_trip_gives_what_encode_and_decode_give(spark, hard, nothing):
    import hashlib

    words = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    both = bpe.decode(bpe.encode(hard, words), words).collect()
    want = [(r.key, list(r.ids), hashlib.sha256(r.text.encode()).hexdigest()) for r in both]
    got = [(r.key, list(r.ids), r.decoded_sha256) for r in bpe.round_trip(hard, words).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(nothing, words).collect() == []
