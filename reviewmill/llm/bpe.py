"""Byte-pair encoding and decoding with forced boundaries."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words remembered by a worker, and the longest one that is.
MEMORY_WORDS = 200_000
MEMORY_LENGTH = 64
#: Symbols of a fragment that are searched without a heap.
SHORT = 40
ROWS = 512


class Vocabulary:
    """What a tokenizer file of the word-end kind says: NFC, lower case, words by a pattern, merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or data["decoder"] is not None:
            raise ValueError("a BPE file with NFC, white space and lower-case normalisation and no decoder is needed")
        self.end = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    @cached_property
    def tokens(self) -> list[str]:
        names = {i: t for t, i in (self.ids | self.special).items()}
        return [names.get(i, "") for i in range(max(names) + 1)]

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self)

    @cached_property
    def symbols(self) -> list[str]:
        """The character that stands for each byte: itself where it prints, else the next free one from U+0100."""
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(0x100, 0x200))
        return [chr(b if b in printable else next(others)) for b in range(256)]

    @cached_property
    def inside(self) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
        """Pairs of neighbouring symbols found inside some token: those before a word's end, and those at it."""
        middle, final = set(), set()
        for token in self.ids:
            ends = bool(self.end) and token.endswith(self.end)
            pairs = list(pairwise(token.removesuffix(self.end) if ends else token))
            if ends and pairs:
                final.add(pairs.pop())
            middle.update(pairs)
        return middle, final


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.words = regex.compile(vocabulary.pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; strings of special tokens become their ids."""
        out, at = [], 0
        for found in self.split_special.finditer(text) if self.split_special else ():
            out += self._ordinary(text[at: found.start()])
            out.append(np.int32(self.v.special[found.group()]).tobytes())
            at = found.end()
        out += self._ordinary(text[at:])
        return np.frombuffer(b"".join(out), np.int32)

    def _ordinary(self, text: str) -> list[bytes]:
        # each character is lowered by itself, so a sigma at a word's end stays the common one
        words = self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            return [known[w] if w in known else self._word(w) for w in words]

    def _word(self, word: str) -> bytes:
        symbols = [self.v.symbols[b] for b in word.encode("utf-8", "replace")]
        ids = [i for part in self.fragments(symbols) for i in self.merged(part)]
        packed = np.array(ids, np.int32).tobytes()
        if len(word) <= MEMORY_LENGTH:
            if len(self.known) >= MEMORY_WORDS:
                self.known.clear()
            self.known[word] = packed
        return packed

    def fragments(self, symbols: list[str]) -> list[list[str]]:
        """Cut where two neighbours stand in no token: no merge can ever cross, so fragments encode by themselves.

        The last symbol of the word carries the end mark.
        """
        middle, final = self.v.inside
        last = len(symbols) - 1
        cuts = [i for i, pair in enumerate(pairwise(symbols), 1) if pair not in (final if i == last else middle)]
        marked = [*symbols[:-1], symbols[-1] + self.v.end]
        return [marked[a:b] for a, b in pairwise([0, *cuts, len(marked)])]

    def merged(self, symbols: list[str]) -> list[int]:
        """Join the neighbours of lowest rank, leftmost first, until none has a rank.

        A short fragment is searched anew for each join, a long one keeps its pairs in a heap.
        """
        part, ranks = list(symbols), self.v.ranks
        if len(part) <= SHORT:
            none = len(ranks)
            order = [ranks.get(p, none) for p in pairwise(part)]
            while order and (least := min(order)) < none:
                i = order.index(least)
                part[i: i + 2] = [part[i] + part[i + 1]]
                del order[i]
                if i:
                    order[i - 1] = ranks.get((part[i - 1], part[i]), none)
                if i < len(order):
                    order[i] = ranks.get((part[i], part[i + 1]), none)
            return [self.v.ids[p] for p in part]
        following, previous = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        queue = [(ranks[p], i, p) for i, p in enumerate(pairwise(part)) if p in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = following[i]
            if j >= len(part) or (part[i], part[j]) != pair:
                continue
            part[i], part[j] = part[i] + part[j], ""
            following[i] = following[j]
            if following[i] < len(part):
                previous[following[i]] = i
            for k in (previous[i], i):
                if k >= 0 and following[k] < len(part) and (new := (part[k], part[following[k]])) in ranks:
                    heapq.heappush(queue, (ranks[new], k, new))
        return [self.v.ids[p] for p in part if p]


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every whole text, however long; null and empty texts have no ids. Repeated rows are encoded
    each, and an empty table gives no rows.

    The vocabulary, of fixed size, goes to every task; words once encoded are remembered up to a bound.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder  # kept by the worker: words of earlier tasks are known
        for part in _parts(batches):
            ids = [encoder.encode(t.as_py() or "") for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(rows, f"key {kind}, ids array<int>")


def decode(coded: DataFrame, vocabulary: Vocabulary, key: str = "key", ids: str = "ids") -> DataFrame:
    """(key, ids, text): the tokens' strings joined by one space, as this kind of file has no decoder. Null is empty."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens
        for part in _parts(batches):
            lists = part.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            names = [tokens[i] for i in flat.tolist()]
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            texts = [" ".join(names[a:b]) for a, b in pairwise([0, *ends])]
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], ["key", "ids", "text"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(
        rows, f"key {kind}, ids array<int>, text string"
    )


def round_trip(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded_sha256): the ids of every whole text and the digest of the text that they decode to, as `encode` and
    `decode` give them, in one pass of one worker: no decoded text leaves it. Null and empty texts have no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = shared.value.encoder, shared.value.tokens
        for part in _parts(batches):
            ids, digests = [], []
            for text in part.column(1):
                own = encoder.encode(text.as_py() or "")
                ids.append(own)
                digests.append(hashlib.sha256(" ".join([tokens[i] for i in own.tolist()]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _lists(ids), pa.array(digests, pa.string())], ["key", "ids", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        rows, f"key {kind}, ids array<int>, decoded_sha256 string"
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32)))
