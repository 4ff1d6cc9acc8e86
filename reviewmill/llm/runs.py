"""Periodic runs of words: stretches that repeat a short sequence of words over and over.

A suffix automaton holds all word sequences of a text; its suffix links form a tree in which the states of a prefix's
suffixes lie on the path from the prefix's state to the root. A link-cut tree over it keeps, for every state, the end of the
last prefix that was accessed through it: states with the same last end form one preferred path. Accessing the next prefix
walks over the segments of its path, from long suffixes with old ends to short ones with recent ends, and paints the whole
path anew. Let a segment's longest suffix have m words and its end lie d words back. These m words are the longest common
suffix of the two prefixes, so d <= m means that the last d words repeat the d before them: a square, whose run of period d
begins d + m words back. A square whose root is a repetition itself shows in a shorter segment, with its smaller period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POWER, MIN_LENGTH = 4, 6
#: Bytes of text that leave a worker in one Arrow batch.
BATCH_BYTES = 8 << 20

_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


# --- the automaton, its links and the painted paths -------------------------------------


def _automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest length and suffix link of every state, and the state of every prefix."""
    length, link, following = [0], [-1], [{}]
    prefixes, last = [], 0
    for symbol in symbols:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        following.append({})
        state = last
        while state >= 0 and symbol not in following[state]:
            following[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = following[state][symbol]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                clone = len(length)
                length.append(length[state] + 1)
                link.append(link[target])
                following.append(dict(following[target]))
                link[target] = link[new] = clone
                while state >= 0 and following[state].get(symbol) == target:
                    following[state][symbol] = clone
                    state = link[state]
        prefixes.append(new)
        last = new
    return length, link, prefixes


class _Paths:
    """Link-cut tree over the suffix links: preferred paths as splay trees by depth, each of one colour, the end of the
    prefix that was accessed last. The colour of a path stands at the root of its splay tree."""

    def __init__(self, parent: list[int]):
        self.parent, self.left, self.right = list(parent), [-1] * len(parent), [-1] * len(parent)
        self.colour = [-1] * len(parent)

    def _splay(self, node: int) -> None:
        parent, left, right = self.parent, self.left, self.right
        while True:
            above = parent[node]
            if above < 0 or (left[above] != node and right[above] != node):
                return
            top = parent[above]
            top_left = top >= 0 and left[top] == above
            inner = top_left or (top >= 0 and right[top] == above)
            if inner and (left[above] == node) == top_left:
                self._rotate(above)
            elif inner:
                self._rotate(node)
            self._rotate(node)

    def _rotate(self, node: int) -> None:
        parent, left, right, colour = self.parent, self.left, self.right, self.colour
        above = parent[node]
        top = parent[above]
        if top >= 0 and left[top] == above:
            left[top] = node
        elif top >= 0 and right[top] == above:
            right[top] = node
        else:
            colour[node] = colour[above]
        if left[above] == node:
            inner = left[above] = right[node]
            right[node] = above
        else:
            inner = right[above] = left[node]
            left[node] = above
        if inner >= 0:
            parent[inner] = above
        parent[above], parent[node] = node, top

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """(last end, deepest state) of every segment between a state and the root, deep ones first; all become `end`."""
        parent, right, colour = self.parent, self.right, self.colour
        segments, node, below = [], state, -1
        while node >= 0:
            self._splay(node)
            segments.append((colour[node], node))
            if right[node] >= 0:
                colour[right[node]] = colour[node]
            right[node] = below
            below, node = node, parent[node]
        self._splay(state)
        colour[state] = end
        return segments


def all_runs(symbols: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal stretch that holds its period at least twice."""
    length, link, prefixes = _automaton(symbols)
    paths, ends = _Paths(link), {}
    for end, state in enumerate(prefixes):
        segments = paths.access(state, end)
        shorter = 0
        for last, node in reversed(segments):  # from the root down
            longest = length[node]
            distance = end - last
            if last >= 0 and shorter < distance <= longest:
                ends[end - distance - longest + 1, distance] = end
            shorter = longest
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


# --- stretches that may hold a run --------------------------------------------------------


def _stretches(hashes: np.ndarray, document: np.ndarray, power: int, min_length: int) -> list[tuple[int, int]]:
    """Stretches of words outside which no run of at least `power` periods and `min_length` words can lie.

    With g = min(2 * power - 3, min_length - 1), such a run of period q has at least 2 q + g - 1 words, so every g words
    in it stand in it once more, q words away, and q is at most its length / power. Words that no recurring g-gram covers
    are in no run; nor are g-grams whose next like is farther than the length of their stretch / power. That is repeated
    until nothing falls away. Equal hashes of unlike words only keep more.
    """
    gram = max(1, min(2 * power - 3, min_length - 1))
    n = len(hashes)
    if n < max(min_length, gram):
        return []
    with np.errstate(over="ignore"):
        mixed = document * _MIX[1]
        for shift in range(gram):
            rolled = hashes[shift : n - gram + 1 + shift]
            mixed[: n - gram + 1] = (mixed[: n - gram + 1] ^ rolled) * _MIX[0]
            mixed[: n - gram + 1] ^= mixed[: n - gram + 1] >> np.uint64(29)
    whole = np.flatnonzero(document[: n - gram + 1] == document[gram - 1 :])
    keys = mixed[whole]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    apart = np.where(same, whole[order[1:]] - whole[order[:-1]], n)
    near = np.full(len(whole), n, dtype=np.int64)
    near[order[1:]] = apart
    near[order[:-1]] = np.minimum(near[order[:-1]], apart)
    alive, near = whole[near < n], near[near < n]
    while len(alive):
        breaks = np.flatnonzero((np.diff(alive) > gram) | (document[alive[1:]] != document[alive[:-1]])) + 1
        first, last = np.r_[0, breaks], np.r_[breaks, len(alive)]
        lengths = alive[last - 1] + gram - alive[first]
        room = np.repeat(np.where(lengths >= min_length, lengths // power, 0), last - first)
        kept = near <= room
        if kept.all():
            return list(zip(alive[first].tolist(), (alive[last - 1] + gram).tolist()))
        alive, near = alive[kept], near[kept]
    return []


def runs_of(texts: list[list[bytes]], power: int = POWER, min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs in each list of words, by start, then period."""
    sizes = [len(words) for words in texts]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    hashes = np.fromiter((hash(w) for words in texts for w in words), np.int64, starts[-1]).view(np.uint64)
    document = np.repeat(np.arange(1, len(texts) + 1, dtype=np.uint64), sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for begin, end in _stretches(hashes, document, power, min_length):
        text = int(document[begin]) - 1
        offset = begin - int(starts[text])
        numbers: dict[bytes, int] = {}
        symbols = [numbers.setdefault(w, len(numbers)) for w in texts[text][offset : offset + end - begin]]
        found[text] += [
            (start + offset, length, period) for start, length, period in all_runs(symbols)
            if length >= max(min_length, power * period)
        ]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run only the first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(kept))


# --- the operator -------------------------------------------------------------------------


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", power: int = POWER, min_length: int = MIN_LENGTH
) -> DataFrame:
    """key, runs (start, length and period in words; by start, then period) and collapsed (the words joined by one space,
    every run cut to its first period) of each row.

    A run is a stretch of words of smallest period q with at least max(min_length, power * q) words, which no neighbouring
    word extends. Words are what ASCII white space separates. A null, empty or blank text has no words, no runs and an
    empty collapsed text. Every row gives one row, repeated rows each their own; other columns, whatever their names, are
    left out, and an empty table gives an empty one. Texts are whole: a very long one takes memory in proportion to its
    length, and the automaton only to its longest stretch that may hold a run.
    """
    if power < 2 or min_length < 2:
        raise ValueError("power and min_length are at least 2")
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("runs", T._parse_datatype_string(f"array<{_RUN}>")),
        T.StructField("collapsed", T.StringType()),
    ])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.large_binary())
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < batch.num_rows:
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), BATCH_BYTES)))
                words = [(t or b"").split() for t in column.slice(begin, end - begin).to_pylist()]
                runs = runs_of(words, power, min_length)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(begin, end - begin),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], _FOUND),
                    pa.array([collapsed(w, rs) for w, rs in zip(words, runs)], pa.binary()).cast(pa.string()),
                ], names=["key", "runs", "collapsed"])
                begin = end

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(find, schema)

