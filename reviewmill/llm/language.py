"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bounded sample that is learned from: rows a language, characters of a row, bytes a language.
SAMPLE_ROWS = 256
SAMPLE_CHARS = 1024
SAMPLE_BYTES = 48_000
UNDETERMINED = "und"
#: Bytes of a text that are parsed as one piece, and pieces that are parsed side by side.
PIECE_BYTES = 1024
PIECES = 4096
_NO_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")
_PHRASES = 29
_STATE = (1 << _PHRASES) - 1


@dataclass(frozen=True)
class LanguageModel:
    """Transitions of the automata of all languages in one table: state * symbols + symbol -> next state and phrases ended."""

    languages: list[str]
    lengths: list[int]
    symbol_of_byte: np.ndarray
    edges: np.ndarray  # (edges, 3): state, symbol, target
    roots: list[int]
    states: int

    def table(self) -> np.ndarray:
        """Dense transitions in which a missing edge ends the phrase and begins the next one at the root."""
        symbols = int(self.symbol_of_byte.max(initial=0)) + 1
        table = np.full((self.states, symbols), -1, np.int32)
        table[self.edges[:, 0], self.edges[:, 1]] = self.edges[:, 2]
        for root, end in zip(self.roots, [*self.roots[1:], self.states], strict=True):
            own, first = table[root:end], table[root].copy()
            known = first >= 0
            # an unknown symbol is a phrase of its own
            again = np.where(known, first | (1 << _PHRASES), root | (2 << _PHRASES)).astype(np.int32)
            np.copyto(own, again, where=own < 0)
            own[0] = np.where(known, first, root | (1 << _PHRASES))
        return table.ravel()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None,
          rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = SAMPLE_BYTES) -> LanguageModel:
    """Learn one suffix automaton a language from a bounded sample of the rows that have text and language.

    The sample is the `rows` rows of smallest `order` (by default a hash of the text) a language, the first `chars`
    characters of each, and `size` bytes in all. The first pass finds each language's bound on `order`, the second
    fetches the rows; ties are taken together and then sorted by text, so a rerun learns the same.
    """
    rank = F.xxhash64(text) if order is None else order
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).withColumn("_rank", rank)
    place = F.row_number().over(Window.partitionBy(lang).orderBy("_rank"))
    bounds = {
        r[0]: r[1]
        for r in labelled.select(lang, "_rank").withColumn("_place", place).where(F.col("_place") <= rows)
        .groupBy(lang).agg(F.max("_rank")).collect()
    }
    if not bounds:
        return LanguageModel([], [], np.zeros(256, np.uint8), np.empty((0, 3), np.int32), [], 0)
    limit = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col(lang)]
    sample: dict[str, list] = {name: [] for name in bounds}
    picked = labelled.where(F.col("_rank") <= limit).select(lang, "_rank", F.substring(text, 1, chars)).distinct()
    place = F.row_number().over(Window.partitionBy(lang).orderBy("_rank", "_text"))
    for name, value, part in picked.toDF(lang, "_rank", "_text").withColumn("_place", place).where(
        F.col("_place") <= rows
    ).drop("_place").collect():
        sample[name].append((value, part))
    return fit({name: b" ".join(letters(part) for _, part in sorted(own))[:size] for name, own in sample.items()})


def fit(texts: dict[str, bytes]) -> LanguageModel:
    languages = sorted(name for name, data in texts.items() if data.strip())
    seen = sorted(set(b"".join(texts[name] for name in languages)))
    symbol_of_byte = np.zeros(256, np.uint8)
    symbol_of_byte[seen] = np.arange(1, len(seen) + 1)
    edges, roots, states = [], [], 0
    for name in languages:
        nodes = suffix_automaton(symbol_of_byte[np.frombuffer(texts[name], np.uint8)].tolist())
        roots.append(states)
        edges += [(states + s, c, states + t) for s, node in enumerate(nodes) for c, t in node.items()]
        states += len(nodes)
    return LanguageModel(languages, [len(texts[name]) for name in languages], symbol_of_byte,
                         np.array(edges, np.int32).reshape(-1, 3), roots, states)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that accepts every substring; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for symbol in symbols:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in edges[at]:
            edges[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = edges[at][symbol]
            if length[target] > length[at] + 1:
                copy = len(edges)
                edges.append(dict(edges[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and edges[at].get(symbol) == target:
                    edges[at][symbol] = copy
                    at = link[at]
                link[target] = copy
                target = copy
            link[new] = target
        last = new
    return edges


def letters(text: str) -> bytes:
    """Lower-case UTF-8 in which every run of ASCII other than letters is one space."""
    return _NO_LETTERS.sub(b" ", text.lower().encode("utf-8", "replace"))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row: the language whose automaton parses the whole text into fewest phrases.

    A phrase is the longest match that begins where the last one ended; its number is multiplied by the logarithm
    of the language's sample size, so unequal samples compare. The score is the runner-up's share of both costs, from
    0.5 (a tie, won by the first language in order) to 1; with one language it is 1. A text that is null or has no letter is
    `und` with score 0, and so is every text when nothing was learned. Long texts are parsed in pieces of fixed size,
    so a prediction depends on its text alone.
    """
    chosen = docs.select(F.col(key).alias("carried"), _has_letter(text), F.col(text).alias("text"))
    return _identified(chosen, model, None).withColumnRenamed("carried", "key")


def identified_rows(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """(carried, lang_pred, score): whole rows of `docs` as a struct, so columns of any name pass, with what `identify` says."""
    chosen = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("carried"), _has_letter(text))
    return _identified(chosen, model, text)


def _has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has_letter")


def _identified(chosen: DataFrame, model: LanguageModel, within: str | None) -> DataFrame:
    """The texts are the third column, or the field `within` of what is carried, so they travel once."""
    shared = chosen.sparkSession.sparkContext.broadcast(model)
    kind = chosen.schema["carried"].dataType.simpleString()
    return chosen.mapInArrow(_Identified(shared, within), f"carried {kind}, lang_pred string, score double")


class _Identified:
    def __init__(self, shared, within: str | None):
        self.shared, self.within = shared, within

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.shared.value
        table = model.table() if model.languages else None
        weights = np.log2(np.maximum(np.array(model.lengths, float), 2))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                texts = part.column(0).field(self.within) if self.within else part.column(2)
                known = [t.as_py() if ok.as_py() else None for t, ok in zip(texts, part.column(1), strict=True)]
                names, scores = self._predict(model, table, weights, known)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["carried", "lang_pred", "score"],
                )

    @staticmethod
    def _predict(model, table, weights, texts) -> tuple[list[str], np.ndarray]:
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not model.languages:
            return names, scores
        data = [b"" if t is None else letters(t) for t in texts]
        costs = phrases(model, table, data) * weights[:, None]
        best = costs.argmin(0)
        rest = costs.copy()
        rest[best, np.arange(len(data))] = np.inf
        runner_up = rest.min(0)
        for i, own in enumerate(data):
            if own:
                names[i] = model.languages[best[i]]
                low, high = costs[best[i], i], runner_up[i]
                scores[i] = 1.0 if math.isinf(high) else high / (low + high)
        return names, scores


def phrases(model: LanguageModel, table: np.ndarray, data: list[bytes]) -> np.ndarray:
    """(languages, texts): phrases that each text takes in each language; all pieces advance side by side."""
    symbols = int(model.symbol_of_byte.max(initial=0)) + 1
    roots = np.array(model.roots, np.int32)[:, None]
    counts = np.zeros((len(roots), len(data)), np.int64)
    pieces = [(len(own[at: at + PIECE_BYTES]), i, at) for i, own in enumerate(data) for at in range(0, len(own), PIECE_BYTES)]
    pieces.sort(reverse=True)
    for first in range(0, len(pieces), PIECES):
        group = pieces[first: first + PIECES]
        lengths = np.array([p[0] for p in group])
        grid = np.zeros((len(group), lengths[0]), np.uint8)
        for row, (n, i, at) in enumerate(group):
            grid[row, :n] = np.frombuffer(data[i], np.uint8, n, at)
        steps = np.ascontiguousarray(model.symbol_of_byte[grid].T)
        state = np.repeat(roots, len(group), axis=1)
        ended = np.zeros_like(state)
        for step, row in enumerate(steps):
            active = int(np.searchsorted(-lengths, -step, "left"))  # pieces longer than the step, longest first
            found = table[state[:, :active] * symbols + row[:active]]
            ended[:, :active] += found >> _PHRASES
            state[:, :active] = found & _STATE
        ended += state != roots
        np.add.at(counts.T, np.array([p[1] for p in group]), ended.T)
    return counts

