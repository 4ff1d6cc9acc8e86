import zlib

import numpy as np

from reviewmill.llm import language
from reviewmill.llm.queries import op2_language


def plain_phrases(text: bytes, reference: bytes, piece: int) -> int:
    count = 0
    for start in range(0, len(text), piece):
        part, at = text[start: start + piece], 0
        while at < len(part):
            n = 1
            while at + n < len(part) and part[at: at + n + 1] in reference:
                n += 1
            if part[at: at + 1] not in reference:
                n = 1
            at += n
            count += 1
    return count


def test_phrases_are_the_longest_matches():
    texts = {"x": b"abracadabra abra cadabra" * 3, "y": b"hocus pocus fidibus " * 4}
    model = language.fit(texts)
    data = [b"abra pocus", b"zzz", b"cadabrahocus zebra", b"", b"a" * 3000]
    got = language.phrases(model, model.table(), data)
    for i, name in enumerate(model.languages):
        assert got[i].tolist() == [plain_phrases(d, texts[name], language.PIECE_BYTES) for d in data]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = op2_language(spark, folder).toPandas()
    known = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas()
    rows = rows.merge(known, on="doc_id")
    assert len(rows) == len(known)
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id]).all()
    own = rows[rows.held_out & rows.lang.notna() & (rows.lang_pred != "und")]
    assert (own.lang == own.lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_hard_rows(hard, nothing):
    model = language.train(hard)
    assert set(model.languages) == {"de", "en", "fr"}
    rows = language.identify(hard, model).collect()
    assert len(rows) == hard.count()
    told = {r.key: (r.lang_pred, r.score) for r in rows if r.key is not None}
    assert all(told[k] == ("und", 0.0) for k in (1, 2, 3, 8))
    assert told[6][0] == "de" and all(0.5 <= told[k][1] <= 1 for k in (4, 5, 6, 9, 10, 11))
    whole = language.identified_rows(hard, model)
    assert whole.count() == hard.count() and whole.select("carried.*").columns == hard.columns
    assert language.identify(nothing, model).count() == 0


def test_nothing_learned(hard, nothing):
    rows = language.identify(hard, language.train(nothing)).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_prediction_depends_on_the_text_alone(spark, documents):
    model = language.train(documents)
    once = {tuple(r) for r in language.identify(documents.repartition(1), model).collect()}
    again = {tuple(r) for r in language.identify(documents.repartition(7), model).collect()}
    assert once == again


def test_sample_is_bounded(documents):
    model = language.train(documents, rows=5, chars=50, size=100)
    assert all(n <= 100 for n in model.lengths)
    assert np.array_equal(model.edges, language.train(documents.repartition(5), rows=5, chars=50, size=100).edges)
