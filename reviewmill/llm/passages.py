"""Near-duplicate passages by compact windows: min-hash signatures, interval joins across hashes, verification."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.scratch import discard, stored

SHINGLE = 5
#: A passage has at least this many words.
PASSAGE_WORDS = 50
SIMILARITY = 0.8
#: Hash functions, and how many of them must agree on a pair of passages.
HASHES = 5
AGREEING = 2
#: Shingles of a text that are hashed at once; positions of windows fit beside their hash in a word.
PIECE = 1 << 20
_INDEX_BITS = np.uint64(24)
_FUNCTION_BITS = 3
#: Reach of a window on either side that is told apart.
_REACH = (1 << 16) - 1
#: Passages are aligned if their offsets fall into one band of this many shingles.
_BAND_BITS = 6
_NEED_BLOCK = 4096
#: Runs of shingles that leave a task at once.
_RUNS = 256
#: Windows of a signature that are linked all with all; the passages of larger groups are compared by their words.
GROUP = 16
#: In place of a hash function: the words of a whole passage are the same.
_WHOLE = (1 << _FUNCTION_BITS) - 1
#: Of a passage's blank: the part of it that is looked at in the next step; signs for passages of either length, the shorter ones
#: beginning where the others do or one word after.
_NARROWED, _EITHER, _AFTER = 5, 2, 3
_BASE = 0x9E3779B97F4A7C15
#: A matching shingle this far from the others' offset belongs to another passage.
_STRAY = 32
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                         0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every run of `shingle` words, A-Z lowered, words parted by ASCII white space."""
    return _shingles(_word_hashes(text), shingle)


def _word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split()
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def _shingles(words: np.ndarray, shingle: int) -> np.ndarray:
    n = len(words) - shingle + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(shingle):
            total = (total ^ words[i: i + n]) * _MULTIPLIERS[i % len(_MULTIPLIERS)]
            total ^= total >> np.uint64(31)
    return total


def compact_windows(hashes: np.ndarray, width: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of the compact windows of at least `width` hashes, in order of their centres.

    All runs of hashes that lie in a window and hold its centre have the centre's hash as their smallest. A position is the
    centre of such a window exactly if it is the (first) smallest of some `width` neighbours; the node above it in the
    Cartesian tree on either side is such a position too, so the tree is built over these few positions only.

    ends: where the texts end that the hashes come from, one after the other; no window reaches over an end.
    """
    n = len(hashes)
    ends = np.array([n]) if ends is None else np.asarray(ends)
    if n < width:
        return (np.empty(0, np.int64),) * 3
    packed = hashes >> _INDEX_BITS << _INDEX_BITS | np.arange(n, dtype=np.uint64)
    reach, least = 1, packed
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: n - width + 1], least[width - reach:])
    if len(ends) > 1:  # runs that lie in one text
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        least = least[text[: n - width + 1] == text[width - 1:]]
        if not len(least):
            return (np.empty(0, np.int64),) * 3
    least = least[np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))]
    centre = (least & ((np.uint64(1) << _INDEX_BITS) - np.uint64(1))).astype(np.int64)
    own = np.searchsorted(ends, centre, side="right")
    begins, last = np.concatenate(([0], ends[:-1]))[own], ends[own] - 1
    # the nearest smaller ones on both sides, whatever their texts
    values = least.tolist()
    values.append(-1)
    before, behind, spine = [], [len(centre)] * len(centre), [-1]
    for i, value in enumerate(least.tolist()):
        top = spine[-1]
        while values[top] > value:
            behind[top] = i
            spine.pop()
            top = spine[-1]
        before.append(top)
        spine.append(i)
    edges = np.concatenate((centre, [n, -1]))
    left, right = np.maximum(edges[before] + 1, begins), np.minimum(edges[behind] - 1, last)
    return left, centre, right


def _windows_of(pieces: list[np.ndarray], owners: list[int], offsets: list[int], hashes: int, width: int) -> Iterator[pa.RecordBatch]:
    """The windows of pieces of texts, some of them at a time: together they have at most PIECE shingles, or are one piece."""
    begin = 0
    while begin < len(pieces):
        end, size = begin + 1, len(pieces[begin])
        while end < len(pieces) and size + len(pieces[end]) <= PIECE:
            size += len(pieces[end])
            end += 1
        together = np.concatenate(pieces[begin:end])
        ends = np.cumsum([len(p) for p in pieces[begin:end]])
        before = np.concatenate(([0], ends[:-1]))
        doc, offset = np.array(owners[begin:end], np.int64), np.array(offsets[begin:end], np.int64)
        signatures, docs_of, places = [], [], []
        for f in range(hashes):
            hashed = _function(together, f)
            left, centre, right = compact_windows(hashed, width, ends)
            own = np.searchsorted(ends, centre, side="right")
            signatures.append(hashed[centre] << np.uint64(_FUNCTION_BITS) | np.uint64(f))
            docs_of.append(doc[own])
            places.append((centre - before[own] + offset[own]) << 32 | np.minimum(centre - left, _REACH) << 16
                          | np.minimum(right - centre, _REACH))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(signatures).view(np.int64)), pa.array(np.concatenate(docs_of)),
             pa.array(np.concatenate(places))], ["signature", "doc", "place"],
        )
        begin = end


def windows(docs: DataFrame, key: str, text: str, hashes: int = HASHES, words: int = PASSAGE_WORDS,
            shingle: int = SHINGLE) -> DataFrame:
    """(signature, doc, place): a row a compact window and hash function; place has its centre and its reach to both sides."""
    width = words - shingle + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                pieces, owners, offsets = [], [], []
                for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    whole = shingle_hashes(value, shingle)
                    # pieces share width - 1 shingles, so each run of `width` lies in one
                    for start in range(0, max(len(whole) - width + 1, 0), PIECE):
                        pieces.append(whole[start: start + PIECE + width - 1])
                        owners.append(doc)
                        offsets.append(start)
                yield from _windows_of(pieces, owners, offsets, hashes, width)

    known = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return known.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(
        _in_runs(rows), "signature long, doc long, place long"
    )


def _function(hashes: np.ndarray, f: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (hashes ^ _MULTIPLIERS[f] >> np.uint64(1)) * _MULTIPLIERS[(f + 3) % len(_MULTIPLIERS)]
        x ^= x >> np.uint64(32)
        return x * _MULTIPLIERS[(f + 5) % len(_MULTIPLIERS)]


class _Linked:
    """Links between the windows of one signature, which come in order of documents, and the windows of large groups.

    In a group of up to `most` windows all pairs of different documents are linked. In a larger one each window is linked
    with the first document and with the one before its own, n-th window with n-th, or last; if it has windows of several
    documents it is a hot group, and those under the first `told` functions are told as rows without `of`, for `whole_passages` to
    split. Of an unfinished signature the next batch is given all windows up to `most`, then the windows of its first and its last
    two documents.
    """

    def __init__(self, most: int, told: int):
        self.most, self.told, self.hot = most, told, _Many(3)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(3)]
        carried = 0
        for batch in batches:
            if len(batch):
                held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
                begins = np.flatnonzero(np.concatenate(([True], held[0][1:] != held[0][:-1])))
                last = int(begins[-1])
                if last:
                    yield from self._groups(*(h[:last] for h in held), carried)
                    held, carried = [h[last:] for h in held], 0
                if carried or len(held[0]) > self.most:
                    yield from self._large(*held, carried)
                    starts = np.flatnonzero(np.concatenate(([True], held[1][1:] != held[1][:-1])))
                    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(held[1]))))
                    keep = np.flatnonzero((run == 0) | (run >= len(starts) - 2))
                    held, carried = [h[keep] for h in held], len(keep)
        if len(held[0]):
            yield from self._groups(*held, carried)

    def _groups(self, signature, doc, place, carried: int) -> Iterator[pa.RecordBatch]:
        """Whole groups; of the first, `carried` windows are linked already and it is large."""
        begins = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1])))
        sizes = np.diff(np.append(begins, len(signature)))
        large = sizes > self.most
        large[0] |= carried > 0
        rows = np.repeat(large, sizes)
        if rows.any():
            yield from self._large(*(a[rows] for a in (signature, doc, place)), carried)
        signature, doc, place = (a[~rows] for a in (signature, doc, place))
        for far in range(1, int(sizes[~large].max(initial=0))):
            y = np.flatnonzero((signature[far:] == signature[:-far]) & (doc[far:] != doc[:-far])) + far
            if len(y):
                yield _links(signature[y], doc[y], place[y], doc[y - far], place[y - far])

    def _large(self, signature, doc, place, carried: int) -> Iterator[pa.RecordBatch]:
        other = np.concatenate(([True], signature[1:] != signature[:-1]))
        starts = np.flatnonzero(other | np.concatenate(([True], doc[1:] != doc[:-1])))
        sizes = np.diff(np.append(starts, len(doc)))
        first = np.maximum.accumulate(np.where(other[starts], np.arange(len(starts)), 0))
        run = np.repeat(np.arange(len(starts)), sizes)
        number = np.arange(len(doc)) - starts[run]
        fresh = np.arange(len(doc)) >= carried
        for to, wanted in ((first[run], run > first[run]), (run - 1, run > first[run] + 1)):
            y = np.flatnonzero(wanted & fresh)
            if len(y):
                x = starts[to[y]] + np.minimum(number[y], sizes[to[y]] - 1)
                yield _links(signature[y], doc[y], place[y], doc[x], place[x])
        y = np.flatnonzero(fresh & ((signature & (1 << _FUNCTION_BITS) - 1) < self.told))
        # a text that repeats a few words has many windows of a signature, but alone it has nobody to be compared with
        doc, place = self.hot.of([signature[y], doc[y], place[y]])[1:]
        if len(doc):
            nothing = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc), nothing, pa.array(place), nothing], ["doc", "of", "place", "shift"])


def _together(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], least: int = 1 << 14) -> Callable:
    """The same rows in batches of at least so many, as each batch costs the workers and the JVM some time."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows(batches):
            held.append(batch)
            size += len(batch)
            if size >= least:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    return joined


def _in_runs(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same rows in large batches, each in order of its first column: rows in sorted runs are quicker to sort in all."""

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(rows, 1 << 18)(batches):
            yield batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))

    return sorted_


def _streamed(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """`step` on sorted rows of a few numbers: as it does the same for each batch and group size, it gets and gives large batches."""
    return _together(lambda batches: step(_together(iter)(batches)))


_LINKS = "doc long, of long, place long, shift long"
_FIRSTS = f"{_LINKS}, right long"
_BLANKS = "signature long, doc long, begin long, blank long"
_FIRSTS_NAMES, _BLANK_NAMES = ([c.split()[0] for c in kind.split(", ")] for kind in (_FIRSTS, _BLANKS))


class _Stretches:
    """Hashes of any stretch of the words of a text: sums over powers of an odd number, brought to where the stretch begins."""

    _powers = _inverse = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        if len(self._powers) <= len(words):
            n = max(len(words) + 1, 1 << 12, 2 * len(self._powers))
            _Stretches._powers, _Stretches._inverse = (
                np.cumprod(np.array([1] + [base] * (n - 1), np.uint64)) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self._powers[: len(words)])))

    def __call__(self, begin: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[begin + size] - self.sums[begin]) * self._inverse[begin]

    def blanked(self, begin: np.ndarray, words: int, low: np.ndarray, high: np.ndarray, less: np.ndarray) -> np.ndarray:
        """Of passages of `words` words without those from `low` to `high`; less: of passages that are shorter by this inside."""
        total = self(begin, low) + self(begin + (high - less), words - high) * self._powers[high]
        total = (total ^ low.astype(np.uint64) * np.uint64(_BASE)) * _MULTIPLIERS[1]
        return total ^ total >> np.uint64(31)


def whole_passages(docs: DataFrame, hot: DataFrame, key: str, text: str, words: int = PASSAGE_WORDS, shingle: int = SHINGLE) -> DataFrame:
    """(left, right, doc, place): a row a passage of exactly `words` words in the windows `hot` (doc, place) that holds their
    centre, and for the passage that begins one word before those of a window; before a text's first word it has a left of its own.

    left and right are hashes of its halves, so all who share both repeat one another, and a link with the first is enough.
    """
    width, half = words - shingle + 1, words // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value, places in zip(*(batch.column(i) for i in range(3)), strict=True):
                hashed = _word_hashes(value.as_py())
                place = places.values.to_numpy(zero_copy_only=False)
                centre = place >> 32
                low = np.maximum(centre - np.minimum(place >> 16 & _REACH, width - 1), 0)
                high = np.minimum(centre, np.minimum(centre + (place & _REACH), len(hashed) - shingle) - width + 1)
                edges = np.zeros(len(hashed) + 3, np.int64)
                some = low <= high
                np.add.at(edges, low[some], 1)
                np.add.at(edges, high[some] + 2, -1)
                begins = np.flatnonzero(np.cumsum(edges) > 0) - 1
                stretch = _Stretches(hashed)
                for at in range(0, len(begins), PIECE):
                    begin = begins[at: at + PIECE]
                    left, right = stretch(np.maximum(begin, 0), half).view(np.int64), stretch(begin + half, words - half).view(np.int64)
                    left[begin < 0] = hash(("before", doc.as_py()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(left), pa.array(right), pa.array(np.full(len(begin), doc.as_py(), np.int64)),
                         pa.array(begin << 32 | (width - 1))], ["left", "right", "doc", "place"],
                    )

    bundles = hot.groupBy("doc").agg(F.collect_list("place").alias("places"))
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("text is not null")
    return own.join(bundles, "doc").select("doc", "text", "places").mapInArrow(_in_runs(rows), "left long, right long, doc long, place long")


class _Many:
    """Of rows in order of signatures, those whose signature another document has too. Of an unfinished signature rows are held
    as long as they are of one document."""

    def __init__(self, columns: int):
        self.held, self.last = [np.empty(0, np.int64) for _ in range(columns)], None

    def of(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """rows: signature, doc and more."""
        held = [np.concatenate(pair) for pair in zip(self.held, rows, strict=True)]
        signature, doc = held[:2]
        if not len(doc):
            return held
        begins = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1])))
        sizes = np.diff(np.append(begins, len(doc)))
        many = np.add.reduceat(doc != np.repeat(doc[begins], sizes), begins) > 0
        many[0] |= self.last is not None and signature[0] == self.last
        self.last = int(signature[-1]) if many[-1] else None
        self.held = [h[len(doc) if many[-1] else begins[-1]:] for h in held]
        return [h[np.repeat(many, sizes)] for h in held]


def _first_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each whole passage, in order of its words and documents, linked with the first of the same words if that is another
    document's. The first ones are rows without `of`, those that share their left half with another document's also without `right`."""
    held: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(4)]
    shared = _Many(3)
    for batch in batches:
        if len(batch):
            carried = len(held[0])
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            left, right, doc, place = held
            begins = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
            x = np.repeat(begins, np.diff(np.append(begins, len(doc))))
            y = np.flatnonzero(doc != doc[x])
            if len(y):
                found = _links(np.full(len(y), _WHOLE), doc[y], place[y], doc[x[y]], place[x[y]])
                yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(len(y), pa.int64())], _FIRSTS_NAMES)
            new = begins[1:] if carried else begins
            many = shared.of([left[new], doc[new], place[new]])
            if len(new):
                nothing = pa.nulls(len(new) + len(many[0]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([doc[new], many[1]])), nothing, pa.array(np.concatenate([place[new], many[2]])), nothing,
                     pa.concat_arrays([pa.array(right[new]), pa.nulls(len(many[0]), pa.int64())])], _FIRSTS_NAMES)
            held = [h[begins[-1]: begins[-1] + 1] for h in held]


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each passage of one signature, in order of documents, linked with the first of them if that is another document's."""
    held: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(3)]
    for batch in batches:
        if len(batch):
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            signature, doc, place = held
            begins = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1])))
            x = np.repeat(begins, np.diff(np.append(begins, len(doc))))
            y = np.flatnonzero(doc != doc[x])
            if len(y):
                yield _links(np.full(len(y), _WHOLE), doc[y], place[y], doc[x[y]], place[x[y]])
            held = [h[begins[-1]: begins[-1] + 1] for h in held]


def _of_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    many = _Many(4)
    for batch in batches:
        rows = many.of([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in rows], _BLANK_NAMES)


def _blanks(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int, size: int) -> DataFrame:
    """(signature, doc, begin, blank): hashes of the wanted passages (doc, begin, blank) without each `size` words of their blank."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value, begin, blank in zip(*(batch.column(i) for i in range(4)), strict=True):
                begin, blank = (a.values.to_numpy(zero_copy_only=False) for a in (begin, blank))
                hashed = _word_hashes(value.as_py())
                own, low, high, less = _narrowed(begin, blank, words, size, len(hashed))
                if len(own):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_Stretches(hashed).blanked(own, words, low, high, less).view(np.int64)),
                         pa.array(np.full(len(own), doc.as_py(), np.int64)), pa.array(own), pa.array(_blank(low, high, less))], _BLANK_NAMES)

    # few texts are wanted in the usual case: Spark copies a small table of them to the tasks, so the others are not moved
    some = stored(wanted.select("doc").distinct(), "passage-texts")
    bundles = wanted.distinct().groupBy("doc").agg(F.collect_list(F.struct("begin", "blank")).alias("some"))
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("text is not null").join(some, "doc", "left_semi")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(parts, "doc").join(bundles, "doc").select("doc", "text", F.col("some.begin"), F.col("some.blank")).mapInArrow(_in_runs(rows), _BLANKS)


def _blank(low, high, less):
    return low << 34 | high << 4 | less


def _narrowed(begin: np.ndarray, blank: np.ndarray, words: int, size: int, n: int) -> tuple[np.ndarray, ...]:
    """(begin, low, high, less): the parts of `size` words of the blanks of some passages in a text of `n` words, in one step for all."""
    low, high, less = blank >> 34, blank >> 4 & (1 << 30) - 1, blank & 3
    either = np.where(less < _EITHER, 1, 2)
    second = np.arange(either.sum()) - np.repeat(np.cumsum(either) - either, either)
    begin, low, high, less = (np.repeat(a, either) for a in (begin, low, high, less))
    begin, less = begin + np.where(less == _AFTER, second, 0), np.where(less < _EITHER, less, second)
    inside = np.flatnonzero((begin >= 0) & (begin + words <= n))
    begin, low, high, less = (a[inside] for a in (begin, low, high, less))
    parts = -((low - high) // size)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, low, high, less = (np.repeat(a, parts) for a in (begin, low, high, less))
    low = low + number * size
    return begin, low, np.minimum(low + size, high), less


def near_links(docs: DataFrame, firsts: DataFrame, key: str, text: str, words: int, shingle: int) -> DataFrame:
    """Links of the passages `firsts` (doc, place, right), no two of which have the same words, that differ by one word: changed,
    or in one of them only. right: a hash of the right half, null for those whose left half is known to be another document's too.

    Such passages share one of their halves; of those that share it with another document's, the rest is compared but for a
    stretch that holds the difference, and the stretch narrowed until it is one word. All who share the other words resemble one
    another, so a link with the first is enough, however many they are; a passage has a bounded number of rows in each step.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def shared(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "signature").sortWithinPartitions("signature").mapInArrow(_streamed(_of_many), _BLANKS).drop("signature")

    def halves(side: DataFrame, low: int, high: int, less: int) -> DataFrame:
        return side.select(F.col("right").alias("signature"), "doc", F.shiftright("place", 32).alias("begin"),
                           F.lit(_blank(low, high, less)).cast("long").alias("blank"))

    half = words // 2
    wanted = halves(firsts.where("right is null"), half, words, _EITHER).drop("signature").unionByName(
        shared(halves(firsts.where("right is not null"), 0, half, _AFTER)))
    size = words - half
    while True:
        size = -(-size // _NARROWED)
        wanted = stored(wanted, "passage-blanks")
        rows = _blanks(docs, wanted, key, text, words, size)
        if size == 1:
            break
        wanted = shared(rows)
    place = (F.shiftleft("begin", 32) + F.lit(words - shingle)).alias("place")
    return rows.select("signature", "doc", place).repartition(parts, "signature").sortWithinPartitions(
        "signature", "doc", "place").mapInArrow(_streamed(_starred), _LINKS)


def _links(signature, doc, place, of, of_place) -> pa.RecordBatch:
    """Where two windows of a signature meet: they share every run of hashes within the shorter reach on each side."""
    centre, of_centre = place >> 32, of_place >> 32
    left = np.minimum(place >> 16 & _REACH, of_place >> 16 & _REACH)
    right = np.minimum(place & _REACH, of_place & _REACH)
    function = signature & (1 << _FUNCTION_BITS) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(of), pa.array(centre << 32 | left << 16 | right),
         pa.array((centre - of_centre) << _FUNCTION_BITS | function)], ["doc", "of", "place", "shift"],
    )


class _Overlaps:
    """Runs of a document that the links of enough hash functions cover, for each pair of documents and band of offsets.

    Links come in order of their documents; those of one document, whose number its text bounds, are held at once.
    """

    def __init__(self, width: int, agreeing: int):
        self.width, self.agreeing = width, agreeing

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(4)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if len(held[0]):
                change = np.flatnonzero(held[0][1:] != held[0][:-1])
                cut = int(change[-1]) + 1 if len(change) else 0
                if cut:
                    yield from self._runs(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield from self._runs(*held)

    def _runs(self, doc, of, place, shift) -> Iterator[pa.RecordBatch]:
        yield from self._banded(doc, of, place, shift, 0)
        # offsets on both sides of a band's edge fall into one of the bands that begin half a band later
        offset = shift >> _FUNCTION_BITS
        order = np.lexsort((offset, of, doc))
        doc, of, place, shift, offset = (a[order] for a in (doc, of, place, shift, offset))
        later = offset + (1 << _BAND_BITS - 1) >> _BAND_BITS
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (of[1:] != of[:-1]) | (later[1:] != later[:-1])))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(doc)))
        band = offset >> _BAND_BITS
        rows = np.repeat(band[first] != band[first + sizes - 1], sizes)
        if rows.any():
            yield from self._banded(doc[rows], of[rows], place[rows], shift[rows], 1 << _BAND_BITS - 1)

    def _banded(self, doc, of, place, shift, later: int) -> Iterator[pa.RecordBatch]:
        offset, function = shift >> _FUNCTION_BITS, shift & (1 << _FUNCTION_BITS) - 1
        low = (place >> 32) - (place >> 16 & _REACH)
        high = (place >> 32) + (place & _REACH)
        order = np.lexsort((low, function, offset + later >> _BAND_BITS, of, doc))
        doc, of, offset, function, low, high = (a[order] for a in (doc, of, offset, function, low, high))
        band = offset + later >> _BAND_BITS
        new_group = np.concatenate(([True], (doc[1:] != doc[:-1]) | (of[1:] != of[:-1]) | (band[1:] != band[:-1])))
        group = np.cumsum(new_group) - 1
        # the links of one function, united: a gap opens where a link begins past all ends before it
        part = np.cumsum(new_group | np.concatenate(([True], function[1:] != function[:-1])))
        ends = np.maximum.accumulate(high + (part << 33)) - (part << 33)
        opens = np.concatenate(([True], (part[1:] != part[:-1]) | (low[1:] > ends[:-1] + 1)))
        at = np.flatnonzero(opens)
        begin, end, owner = low[at], np.maximum.reduceat(high, at), group[at]
        weight = np.where(function[at] == _WHOLE, self.agreeing, 1)
        # how many functions cover each place
        places = np.concatenate([begin, end + 1])
        step = np.concatenate([weight, -weight])
        owner = np.concatenate([owner, owner])
        order = np.lexsort((-step, places, owner))
        places, owner = places[order], owner[order]
        deep = np.cumsum(step[order]) >= self.agreeing
        before = np.concatenate(([False], deep[:-1]))
        begin, end, owner = places[deep & ~before], places[~deep & before] - 1, owner[deep & ~before]
        long = end - begin + 1 >= self.width
        begin, end, owner = begin[long], end[long], owner[long]
        if not len(owner):
            return
        first = np.flatnonzero(new_group)
        least, most = np.minimum.reduceat(offset, first)[owner], np.maximum.reduceat(offset, first)[owner]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in (doc[first][owner], begin, end, of[first][owner], np.maximum(begin - most, 0), end - least)],
            ["doc", "begin", "end", "of", "of_begin", "of_end"],
        )


_PAIRS = "doc long, begin long, end long, of long, of_begin long, of_end long"


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", hashes: int = HASHES, agreeing: int = AGREEING,
               words: int = PASSAGE_WORDS, shingle: int = SHINGLE) -> DataFrame:
    """Pairs of passages, as runs of shingles, on which at least `agreeing` hash functions agree, or that lie in hot groups of
    several documents and have the same words but for one."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # two passages meet in a hot group of some function, or as many as have to agree link them, if so many agree
    linked = stored(
        windows(docs, key, text, hashes, words, shingle).repartition(parts, "signature")
        .sortWithinPartitions("signature", "doc", "place").mapInArrow(_streamed(_Linked(GROUP, hashes)), _LINKS), "passage-links",
    )
    whole = stored(
        whole_passages(docs, linked.where("of is null").select("doc", "place"), key, text, words, shingle)
        .repartition(parts, "left").sortWithinPartitions("left", "right", "doc", "place").mapInArrow(_streamed(_first_linked), _FIRSTS),
        "passage-wholes",
    )
    near = near_links(docs, whole.where("of is null"), key, text, words, shingle)
    overlaps = _Overlaps(words - shingle + 1, agreeing)
    links = linked.where("of is not null").unionByName(whole.where("of is not null").select(*linked.columns)).unionByName(near)
    pairs = stored(
        links.repartition(parts, "doc", "of").sortWithinPartitions("doc").mapInArrow(_streamed(overlaps), _PAIRS), "passage-pairs",
    )
    discard(linked)
    discard(whole)
    return pairs


def slices(docs: DataFrame, needs: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc, begin, end, hashes): the shingles of each wanted run, 32 bits each. Each text is hashed once for a bundle of runs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hashed = None, None
        for batch in batches:
            for doc, value, runs in zip(*(batch.column(i) for i in range(3)), strict=True):
                value, runs = value.as_py(), runs.as_py()
                if value != last:
                    last, hashed = value, shingle_hashes(value, shingle).astype(np.uint32)
                begin, end = [r["begin"] for r in runs], [r["end"] for r in runs]
                cut = [hashed[b: e + 1].tobytes() for b, e in zip(begin, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * len(runs), pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()),
                     pa.array(cut, pa.binary())], ["doc", "begin", "end", "hashes"],
                )

    bundles = needs.distinct().groupBy("doc", (F.col("begin") / _NEED_BLOCK).cast("long").alias("block")).agg(
        F.collect_list(F.struct("begin", "end")).alias("runs")
    )
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("text is not null")
    return own.join(bundles, "doc").select("doc", "text", "runs").mapInArrow(
        _together(rows, _RUNS), "doc long, begin long, end long, hashes binary"
    )


class _Verified:
    def __init__(self, words: int, shingle: int, similarity: float):
        self.words, self.shingle, self.similarity = words, shingle, similarity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, begin, of, of_begin, own, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, other = np.frombuffer(own, np.uint32), np.frombuffer(other, np.uint32)
                for low, high, of_low, of_high, similarity in similar_runs(own, other, self.words - self.shingle + 1, self.similarity):
                    out.append((doc, begin + low, begin + high + self.shingle, of, of_begin + of_low, of_begin + of_high + self.shingle, similarity))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.float64())],
                ["doc_id", "begin", "end", "of_doc_id", "of_begin", "of_end", "similarity"],
            )


def similar_runs(own: np.ndarray, other: np.ndarray, width: int, similarity: float) -> list[tuple]:
    """Runs of `own` that a run of `other` resembles: (begin, end, begin in other, end in other, Jaccard), ends included.

    Matching stretches are joined while the share of matches allows it, first generously, then, where the whole is not
    similar enough, more strictly.
    """
    if len(own) >= width and len(own) == len(other) and (own == other).all():
        return [(0, len(own) - 1, 0, len(own) - 1, 1.0)]
    # the occurrence in `other` that lies nearest to the same place, as both runs begin where they are aligned
    keys = np.empty(len(other) + 2, np.uint64)  # one more at either end, which is no occurrence
    keys[1:-1] = other
    keys[1:-1] <<= np.uint64(32)
    keys[1:-1] |= np.arange(len(other), dtype=np.uint64)
    keys[1:-1].sort()
    keys[0], keys[-1] = keys[1], keys[-2]
    here = np.arange(len(own), dtype=np.uint64)
    after = np.searchsorted(keys[1:-1], own.astype(np.uint64) << np.uint64(32) | here)
    before, behind = keys[after], keys[after + 1]
    is_before = (before >> np.uint64(32) == own) & (after > 0)
    is_behind = (behind >> np.uint64(32) == own) & (after < len(other))
    before, behind, here = ((a & np.uint64(0xFFFFFFFF)).view(np.int64) for a in (before, behind, here))
    found = is_before | is_behind
    where = np.where(is_before & (~is_behind | (here - before <= behind - here)), before, behind)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], found.view(np.int8), [0]))))
    stretches = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))
    out = []
    for share in (similarity, (1 + similarity) / 2, 1.0):
        failed = []
        for begin, end in _joined(stretches, share):
            if end - begin + 1 < width:
                continue
            inside = np.flatnonzero(found[begin: end + 1]) + begin
            shift = inside - where[inside]
            usual = np.sort(shift)[len(shift) // 2]
            near = where[inside][np.abs(shift - usual) <= _STRAY + (end - begin) // 8]
            low, high = int(near.min()), int(near.max())
            a, b = _distinct(own[begin: end + 1]), _distinct(other[low: high + 1])
            together = np.sort(np.concatenate((a, b)))
            both = int(np.count_nonzero(together[1:] == together[:-1]))
            jaccard = both / (a.size + b.size - both)
            if jaccard >= similarity:
                out.append((begin, end, low, high, jaccard))
            else:
                failed += [s for s in stretches if begin <= s[0] and s[1] <= end]
        stretches = failed
    return out


def _distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]


def _joined(stretches: list[tuple[int, int]], share: float) -> list[tuple[int, int]]:
    stack: list[list[int]] = []  # begin, end, matches
    for begin, end in stretches:
        stack.append([begin, end, end - begin + 1])
        while len(stack) > 1 and stack[-1][2] + stack[-2][2] >= share * (stack[-1][1] - stack[-2][0] + 1):
            last = stack.pop()
            stack[-1][1], stack[-1][2] = last[1], stack[-1][2] + last[2]
    return [(b, e) for b, e, _ in stack]


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS,
                      shingle: int = SHINGLE, similarity: float = SIMILARITY, hashes: int = HASHES,
                      agreeing: int = AGREEING) -> DataFrame:
    """(doc_id, begin, end, of_doc_id, of_begin, of_end, similarity): passages that resemble one of a smaller doc_id.

    Positions count words, ends excluded. A passage has `words` words or more, and the sets of its shingles and of the other's
    have a Jaccard similarity of `similarity` or more. Of a signature that few windows share, all pairs
    are linked. Of a hot one they are linked in a star and a chain, and each passage of `words` words in them with the first
    document that has the same words, or the same but for one: changed, or in one of both only. That is all in which passages of
    this length may differ at similarity 0.8, so whoever else shares their lines, such repeats are found; where other
    arguments let more words differ, the star and the chain alone link those. All texts are hashed whole; what the
    hash functions propose is verified against the shingles themselves. Repeats within one document are not reported;
    rows without key or text, and texts shorter than a passage, take no part; rows that repeat a key are one document.
    """
    pairs = candidates(docs, key, text, hashes, agreeing, words, shingle)
    needs = pairs.select("doc", "begin", "end").unionByName(
        pairs.select(F.col("of").alias("doc"), F.col("of_begin").alias("begin"), F.col("of_end").alias("end"))
    )
    runs = stored(slices(docs, needs, key, text, shingle), "passage-runs")
    other = runs.select(F.col("doc").alias("of"), F.col("begin").alias("of_begin"), F.col("end").alias("of_end"),
                        F.col("hashes").alias("of_hashes"))
    both = pairs.join(runs, ["doc", "begin", "end"]).join(other, ["of", "of_begin", "of_end"])
    return both.select("doc", "begin", "of", "of_begin", "hashes", "of_hashes").mapInArrow(
        _Verified(words, shingle, similarity),
        "doc_id long, begin long, end long, of_doc_id long, of_begin long, of_end long, similarity double",
    )


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, begin, end, of_doc_ids): overlapping passages of a document united, with the documents they repeat."""
    order = Window.partitionBy("doc_id").orderBy("begin", "end")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.distinct().withColumn("_ahead", ahead)
    island = F.sum(F.when(F.col("_ahead").isNull() | (F.col("begin") > F.col("_ahead")), 1).otherwise(0)).over(order)
    return marked.withColumn("_island", island).groupBy("doc_id", "_island").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.sort_array(F.collect_set("of_doc_id")).alias("of_doc_ids")
    ).drop("_island")


def cut_texts(docs: DataFrame, cuts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the words of `cuts` (doc_id, begin, end), which do not overlap; a row for each row of `docs`.

    Rows whose key has no cuts, and rows without key or text, stay as they are.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                without(t.as_py(), [(c["begin"], c["end"]) for c in own.as_py() or ()])
                for t, own in zip(batch.column(0).field(text), batch.column(1), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    listed = cuts.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_cuts"))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("_key"))
    joined = whole.join(listed, F.col("_key") == F.col("_doc"), "left").select("row", "_cuts")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(rows, f"row {kind}, text string").select(
        *[(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def without(text: str | None, cuts: list[tuple[int, int]]) -> str | None:
    """The text without the words of the given spans, and without the white space after each span."""
    if text is None or not cuts:
        return text
    starts = [m.start() for m in _WORD.finditer(text)]
    starts.append(len(text))
    kept = pairwise([0, *(p for begin, end in sorted(cuts) for p in (starts[min(begin, len(starts) - 1)], starts[min(end, len(starts) - 1)])), len(text)])
    return "".join(text[a:b] for i, (a, b) in enumerate(kept) if i % 2 == 0)
