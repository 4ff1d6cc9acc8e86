import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from reviewmill.llm.scratch import stored
from tests.llm.test_mixing import plain_targets
from tests.llm.test_passages import shingles
from tests.llm.test_simhash import plain_print, plain_roots


@pytest.fixture(scope="module")
def steps(spark, folder, documents):
    """The rows before and after each stage."""
    docs, out = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, folder), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns_stay_until_the_last_stage(steps, documents):
    for name, (_, after) in list(steps.items())[:-1]:
        assert after.columns == documents.columns and dict(after.dtypes) == dict(documents.dtypes), name
        assert all(r.n_chars == len(r.text) for r in after.select("n_chars", "text").collect() if name in ("passages", "mixing"))


def test_language_rejects_what_has_no_letter(steps):
    before, after = map(texts, steps["language"])
    assert after == {d: t for d, t in before.items() if t and any(c.isalpha() for c in t)}


def test_one_of_each_group_of_near_copies_stays(steps):
    before, after = map(texts, steps["near_copies"])
    docs = sorted(before)
    roots = plain_roots([plain_print(before[d]) for d in docs])
    assert set(after) == {docs[i] for i in set(roots.tolist())} and all(after[d] == before[d] for d in after)
    assert len(after) < len(before)


def test_unlike_texts_under_one_id_all_stay(spark):
    one, two = "first text with words of its own here", "second text that says something quite different indeed"
    rows = [(1, one), (1, two), (2, one), (None, two + " and more and more words"), (3, two)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, one), (1, two), (0, rows[3][1])])


def test_repeated_passages_are_cut_once(steps):
    before, after = map(texts, steps["passages"])
    seen, cut = set(), 0
    for doc in sorted(before):
        own, left = before[doc].lower().split(), after.get(doc, "").lower().split()
        runs = {tuple(own[i: i + 50]) for i in range(len(own) - 49)}
        kept = {tuple(left[i: i + 50]) for i in range(len(left) - 49)}
        assert not kept & runs & seen
        cut += len(own) - len(left)
        if not runs & seen and not any(len(shingles(own) & shingles(before[d].lower().split())) > 30 for d in before if d < doc):
            assert after[doc] == before[doc]
        seen |= runs
    assert cut > 0


def test_mixing_meets_the_targets(steps):
    before, after = steps["mixing"]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    source = {r.doc_id: (r.source, len(word.findall(r.text))) for r in before.collect()}
    sizes, taken = {}, {}
    for name, n in source.values():
        sizes[name] = sizes.get(name, 0) + n
    for doc, text in texts(after).items():
        name, n = source[doc]
        own = len(word.findall(text))
        assert 0 < own <= 3 * n
        taken[name] = taken.get(name, 0) + own
    expected = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - t) <= max(130, 0.02 * t) for s, t in expected.items())
    original = texts(before)
    assert all(set(word.findall(t)) <= set(word.findall(original[d])) for d, t in texts(after).items())


def test_tokens_are_those_of_the_library(steps):
    before, after = steps["tokens"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids) for r in after.collect()}
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts(before).items()}
    assert got == {d: (len(ids), ids) for d, ids in want.items()}


def test_run_gives_the_last_stage(spark, folder, steps):
    rows = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()}
    assert rows == {(r.doc_id, tuple(r.ids)) for r in steps["tokens"][1].collect()}
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_hard_rows(spark, hard, nothing, number):
    name, stage = corpus_pipeline.STAGES[number]
    after = stage(spark, hard, "")
    assert nothing.columns == stage(spark, nothing, "").columns or name == "tokens"
    assert stage(spark, nothing, "").count() == 0
    got = sorted((r.doc_id for r in after.collect()), key=lambda d: (d is None, d))
    assert got == {
        "language": [4, 5, 6, 7, 9, 9, 10, 11, None],
        "near_copies": [1, 4, 5, 6, 8, 9, 11, None],
        "passages": [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, None, None],
        "mixing": [d for d in got if d not in (1, 2, 3)],
        "tokens": [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, None, None],
    }[name]
