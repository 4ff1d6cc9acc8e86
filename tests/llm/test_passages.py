import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reviewmill.llm import passages
from reviewmill.llm.queries import op4_passages


def words(seed, n):
    draw = random.Random(seed)
    return [f"{draw.choice('bcdfgklmnprst')}{draw.choice('aeiou')}{draw.randrange(5000)}" for _ in range(n)]


def shingles(own):
    return {tuple(own[i: i + 5]) for i in range(len(own) - 4)}


def test_compact_windows_are_those_of_the_definition():
    draw = np.random.default_rng(1)
    for n, width in ((0, 4), (3, 4), (4, 4), (60, 4), (200, 7), (300, 46), (50, 1)):
        hashes = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        got = set(zip(*(a.tolist() for a in passages.compact_windows(hashes, width)), strict=True))
        expected = set()
        for c in range(n):
            left = c
            while left and hashes[left - 1] > hashes[c]:
                left -= 1
            right = c
            while right + 1 < n and hashes[right + 1] >= hashes[c]:
                right += 1
            if right - left + 1 >= width:
                expected.add((left, c, right))
        assert got == expected


def test_every_exact_repeat_is_covered_and_every_report_is_true(spark, folder, documents):
    texts = {r.doc_id: (r.text or "").lower().split() for r in documents.collect()}
    found = passages.repeated_passages(documents).collect()
    covered = {}
    for r in found:
        own, other = texts[r.doc_id][r.begin: r.end], texts[r.of_doc_id][r.of_begin: r.of_end]
        a, b = shingles(own), shingles(other)
        assert r.of_doc_id < r.doc_id and len(own) >= 50 and len(a & b) / len(a | b) >= 0.8
        covered.setdefault(r.doc_id, set()).update(range(r.begin, r.end))
    seen = {}
    for doc in sorted(texts):
        own = texts[doc]
        runs = [tuple(own[i: i + 50]) for i in range(len(own) - 49)]
        for i, run in enumerate(runs):
            if seen.get(run, doc) != doc:
                assert covered[doc].issuperset(range(i, i + 50))
        for run in runs:
            seen.setdefault(run, doc)
    rows = op4_passages(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(covered)
    assert sum(r.end - r.begin for r in rows) == sum(map(len, covered.values()))


def test_planted_passages_and_a_hot_one(spark):
    hot, near = words(1, 60), words(2, 80)
    changed = near[:40] + ["other"] + near[41:]
    longer = near[:30] + ["one", "more"] + near[30:]
    rows = [(i, " ".join(words(100 + i, 30) + hot + words(1000 + i, 30))) for i in range(300)]
    rows += [(500, " ".join(words(7, 50) + near)), (501, " ".join(changed + words(8, 9))), (502, " ".join(words(9, 20) + longer)),
             (503, " ".join(words(10, 200))), (504, " ".join(words(1, 45)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = passages.spans(passages.repeated_passages(frame)).collect()
    by_doc = {r.doc_id: r for r in found}
    assert set(by_doc) == set(range(1, 300)) | {501, 502}
    assert all(by_doc[i].begin == 30 and by_doc[i].end == 90 and 0 in by_doc[i].of_doc_ids for i in range(1, 300))
    assert by_doc[501].of_doc_ids[0] == 500 and by_doc[501].end - by_doc[501].begin >= 75


def test_passage_within_repeated_lines(spark):
    lines = " ".join(["again and again the very same line of ten words"] * 20)
    frame = spark.createDataFrame([(1, lines), (2, lines), (3, "before it " + lines)], "doc_id long, text string")
    got = {(r.doc_id, r.begin) for r in passages.spans(passages.repeated_passages(frame)).collect()}
    assert {d for d, _ in got} == {2, 3}


def test_exact_repeats_whose_words_are_mostly_a_hot_line(spark):
    line = words(3, 35)
    rows = [(i, " ".join(words(5000 + i, 40) + line + words(6000 + i, 40))) for i in range(200)]
    for pair in range(40):
        whole = words(7000 + pair, 25) + line
        rows += [(1000 + pair, " ".join(words(8000 + pair, 30) + whole + words(8100 + pair, 30))),
                 (2000 + pair, " ".join(words(8200 + pair, 50) + whole + words(8300 + pair, 20)))]
    rows += [(i, " ".join(words(5000 + i, 40) + line + words(6000 + i, 40))) for i in range(3000, 3200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = passages.spans(passages.repeated_passages(frame)).collect()
    by_doc = {r.doc_id: (r.begin, r.end, list(r.of_doc_ids)) for r in found}
    assert by_doc == {2000 + pair: (50, 110, [1000 + pair]) for pair in range(40)}


def test_part_of_a_passage_before_the_whole(spark):
    rows = []
    for pair in range(60):
        whole = words(9000 + pair, 50)
        rows += [(pair, " ".join(whole[:40] + words(9100 + pair, 300) + whole + words(9200 + pair, 9))),
                 (100 + pair, " ".join(words(9300 + pair, 70) + whole + words(9400 + pair, 9)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = passages.spans(passages.repeated_passages(frame)).collect()
    assert {r.doc_id: (r.begin, r.end) for r in found} == {100 + pair: (70, 120) for pair in range(60)}


def test_links_do_not_depend_on_batches():
    draw = np.random.default_rng(4)
    signature = np.sort(draw.integers(0, 12, 400) ** 2 * 8)
    doc = np.concatenate([np.sort(draw.integers(0, 40, n)) for n in np.unique(signature, return_counts=True)[1]])
    place = np.arange(400) << 32
    table = pa.table({"signature": signature, "doc": doc, "place": place})
    whole = None
    for size in (400, 1, 7, 33):
        linked = passages._Linked(16, 2)(iter(table.to_batches(max_chunksize=size)))
        rows = sorted(tuple(r.values()) for b in linked for r in b.select(["doc", "place", "shift"]).to_pylist() if r["shift"] is not None)
        whole = whole or rows
        assert rows == whole
    got = {(r[1] >> 32, (r[1] >> 32) - (r[2] >> 3)) for r in whole}
    small = {s for s, n in zip(*np.unique(signature, return_counts=True), strict=True) if n <= 16}
    assert got >= {(y, x) for y in range(400) for x in range(y) if signature[x] == signature[y] in small and doc[x] < doc[y]}


def test_windows_of_one_document_alone_are_not_told():
    # a text that says one word over and over, one that two such texts share, in portions of any size
    signature = np.repeat([8, 16, 24], [50, 60, 40])
    doc = np.concatenate([np.full(50, 1), np.repeat([2, 3], 30), np.full(40, 4)])
    place = np.arange(150) << 32
    table = pa.table({"signature": signature, "doc": doc, "place": place})
    for size in (150, 1, 7, 33):
        rows = [r for b in passages._Linked(16, 5)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted(r["place"] >> 32 for r in rows if r["of"] is None) == list(range(50, 110))
        assert {(r["doc"], r["of"]) for r in rows if r["of"] is not None} == {(3, 2)}


def test_blanks_are_narrowed_in_one_step():
    draw = np.random.default_rng(5)
    for size in (1, 2, 5, 7):
        begin, low = draw.integers(-1, 60, 300), draw.choice([0, 25, 27], 300)
        high, less = low + draw.choice([1, 5, 25], 300), draw.integers(0, 4, 300)
        expected = []
        for b, lo, hi, how in zip(*(a.tolist() for a in (begin, low, high, less)), strict=True):
            for shorter in (how,) if how < 2 else (0, 1):
                at = b + (shorter if how == 3 else 0)
                if 0 <= at <= 50:
                    expected += [(at, x, min(x + size, hi), shorter) for x in range(lo, hi, size)]
        got = passages._narrowed(begin, passages._blank(low, high, less), 50, size, 100)
        assert sorted(zip(*(a.tolist() for a in got), strict=True)) == sorted(expected)


def test_small_batches_are_joined():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3])], ["a"])
    joined = list(passages._together(lambda batches: batches, 7)(iter([batch] * 8)))
    assert [len(b) for b in joined] == [9, 9, 6] and not list(passages._together(lambda batches: batches)(iter([])))


def test_rows_are_handed_over_in_sorted_runs():
    batches = [pa.RecordBatch.from_arrays([pa.array([9 - i, -i]), pa.array([i, i])], ["a", "b"]) for i in range(6)]
    (run,) = passages._in_runs(lambda rows: rows)(iter(batches))
    assert run.to_pylist() == sorted((row for b in batches for row in b.to_pylist()), key=lambda row: row["a"])
    assert list(passages._in_runs(lambda rows: rows)(iter([]))) == []


def test_hard_rows(hard, nothing):
    rows = passages.spans(passages.repeated_passages(hard)).collect()
    assert [(r.doc_id, r.begin, r.end, r.of_doc_ids) for r in rows] == [(7, 0, 120_000, [6])]
    cut = passages.cut_texts(hard, passages.spans(passages.repeated_passages(hard)))
    assert cut.columns == hard.columns and cut.count() == hard.count()
    assert cut.where("doc_id = 7").first().text == "end"
    unchanged = F.coalesce(F.col("doc_id"), F.lit(-1)) != 7
    assert sorted(map(str, cut.where(unchanged).collect())) == sorted(map(str, hard.where(unchanged).collect()))
    assert passages.repeated_passages(nothing).count() == 0 and passages.cut_texts(nothing, passages.spans(passages.repeated_passages(nothing))).count() == 0


def test_pieces_of_long_texts_share_windows(monkeypatch, spark):
    monkeypatch.setattr(passages, "PIECE", 64)
    docs = spark.createDataFrame([(1, " ".join(words(3, 500)))], "doc_id long, text string")
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    hashes = passages.shingle_hashes(batch.column(1)[0].as_py())
    starts = range(0, len(hashes) - 45, 64)
    centres = {c + s for s in starts for c in passages.compact_windows(hashes[s: s + 64 + 45], 46)[1].tolist()}
    assert centres >= set(passages.compact_windows(hashes, 46)[1].tolist())


def test_without():
    assert passages.without("a b  c d e", [(1, 3)]) == "a d e"
    assert passages.without("a b c", [(0, 3)]) == ""
    assert passages.without(None, [(0, 1)]) is None and passages.without("x", []) == "x"
    assert passages.without(" a b c d", [(0, 1), (2, 3)]) == " b d"


def test_windows_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 1 << 63, int(n), dtype=np.uint64) for n in (3, 46, 45, 200, 0, 1000, 60)]
    ends = np.cumsum([len(t) for t in texts])
    got = list(zip(*(a.tolist() for a in passages.compact_windows(np.concatenate(texts), 46, ends)), strict=True))
    want = [tuple(int(x) + int(end) - len(t) for x in w) for t, end in zip(texts, ends, strict=True)
            for w in zip(*passages.compact_windows(t, 46), strict=True)]
    assert got == want


def test_offsets_on_both_sides_of_a_band(spark):
    """Two functions agree on a passage with offsets 63 and 64: one band begins between them."""
    overlaps = passages._Overlaps(46, 2)

    def runs(offsets):
        rows = [np.array(c, np.int64) for c in zip(*[
            (9, 4, (200 << 32) | (60 << 16) | 60, (o << passages._FUNCTION_BITS) | f) for f, o in enumerate(offsets)])]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["doc", "of", "place", "shift"])
        return {(r["begin"], r["end"]) for b in overlaps([batch]) for r in b.to_pylist()}

    assert runs([63, 64]) == runs([60, 60]) == {(140, 260)}
    assert runs([10, 200]) == set()


def one_changed(own, place, new):
    """The word at `place` changed, one added before it, or it dropped, by turns."""
    return [own[:place] + [new] + own[place + 1:], own[:place] + [new] + own[place:], own[:place] + own[place + 1:]][place % 3]


def test_near_repeats_that_hold_a_hot_line(spark):
    line = words(31, 35)
    rows = [(i, " ".join(words(15000 + i, 40) + line + words(16000 + i, 40))) for i in range(100)]
    for pair in range(60):
        own = words(17000 + pair, 25)
        first, second = own + line, one_changed(own, 6 + pair % 18, f"new{pair}") + line
        if pair % 2:
            first, second = second, first
        rows += [(1000 + pair, " ".join(words(18000 + pair, 30) + first + words(18100 + pair, 30))),
                 (2000 + pair, " ".join(words(18200 + pair, 50) + second + words(18300 + pair, 20)))]
    rows += [(i, " ".join(words(15000 + i, 40) + line + words(16000 + i, 40))) for i in range(3000, 3100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in passages.spans(passages.repeated_passages(frame)).collect()}
    assert {d: list(r.of_doc_ids) for d, r in found.items()} == {2000 + pair: [1000 + pair] for pair in range(60)}
    assert all(r.begin <= 52 and r.end >= 107 for r in found.values())


def test_variants_of_one_hot_text(spark):
    """One word changed in each of many copies: each passage that differs in one word from an earlier one is found."""
    text = words(41, 60)
    changed = [random.Random(i).randrange(60) for i in range(120)]
    rows = [(i, " ".join(words(19000 + i, 9) + text[:c] + [f"own{i}"] + text[c + 1:] + words(19500 + i, 9))) for i, c in enumerate(changed)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id for r in passages.repeated_passages(frame).collect()}
    want = set()
    for i, c in enumerate(changed):
        for low in range(0, 11):
            for high in range(low + 50, 61):
                own = text[:c] + ["own"] + text[c + 1:]
                a = shingles(own[low:high])
                for d in set(changed[:i]):
                    b = shingles((text[:d] + ["other"] + text[d + 1:])[low:high])
                    ends = all(not q <= x <= q + 4 for q in (c, d) for x in (low + 4, high - 1))
                    if ends and len(a & b) / len(a | b) >= 0.8:
                        want.add(i)
    assert found >= want and len(want) > 60
