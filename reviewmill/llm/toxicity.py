"""Toxic text: a bidirectional gated recurrent network with attention pooling, trained and applied in numpy.

A text is scored window by window, in windows that overlap by half, so that a few words in a long text are not diluted. Every
word enters the network twice: as an entry of a vocabulary learned from the labelled rows, and as its characters, the sum
of learned vectors of its 3- to 5-grams with marks at both ends, which also serves words never seen before. A gated
recurrent layer reads the window in both directions, attention weighs its states, and a linear unit gives the window's
value. The text's value is that of its highest window; which window of a toxic row is the toxic one is learned on the way.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, STRIDE = 32, 16
#: Bounds of the sample that the network learns from: rows of each label, windows of a row, words of the vocabulary.
TOXIC_ROWS, CLEAN_ROWS, WINDOWS_A_ROW, VOCABULARY = 800, 1600, 64, 20_000
#: Of the sampled rows, every CALIBRATION-th only sets the scale of the scores.
CALIBRATION = 5
MIN_ROWS = 3  # rows of the sample that hold a word of the vocabulary
WORD_SIZE, GRAM_SIZE, GRAM_BITS, HIDDEN, ATTENTION = 12, 12, 14, 12, 12
GRAMS = (3, 4, 5)
EPOCHS, RANDOM_SHARE, LEAST_STEPS, BATCH = 8, 0.25, 200, 128
#: Shares of the word types of a batch that pass as unknown words, and as words without characters; rate of the vectors
#: against that of the other parameters.
HIDE_WORD, HIDE_GRAMS, VECTOR_RATE = 0.3, 0.2, 8
#: Windows computed at once, words kept by a worker with their inputs to the network, texts' bytes taken at once.
TOGETHER, KEPT_WORDS, CHUNK_BYTES = 4096, 100_000, 4 << 20

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def window_starts(words: int) -> range:
    """First words of the overlapping windows that together hold every word."""
    return range(0, max(1, words - STRIDE), STRIDE) if words else range(0)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words in a row, and the number of them in each word (one at least)."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4")
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    found, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(room >= n)
        mixed = np.full(len(at), n, np.uint32)
        for shift in range(n):
            mixed = (mixed ^ codes[at + shift]) * np.uint32(0x01000193)
            mixed ^= mixed >> np.uint32(15)
        found.append((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS))
        owners.append(owner[at])
    owners = np.concatenate(owners)
    return np.concatenate(found)[np.argsort(owners, kind="stable")].astype(np.int64), np.bincount(owners, minlength=len(words))


# --- the network ------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _new_parameters(words: int, random: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int) -> np.ndarray:
        return (random.normal(size=shape) / np.sqrt(shape[-2])).astype(np.float32)

    return {
        "words": (0.1 * random.normal(size=(words, WORD_SIZE))).astype(np.float32),
        "grams": (0.1 * random.normal(size=(1 << GRAM_BITS, GRAM_SIZE))).astype(np.float32),
        "inward": normal(2, WORD_SIZE + GRAM_SIZE, 3 * HIDDEN),
        "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
        "across": normal(2, HIDDEN, 3 * HIDDEN),
        "look": normal(2 * HIDDEN, ATTENTION),
        "ask": normal(ATTENTION, 1)[:, 0],
        "weigh": normal(2 * HIDDEN, 1)[:, 0],
        "level": np.zeros(1, np.float32),
    }


def _gram_sums(grams: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.add.reduceat(grams[buckets], np.cumsum(counts) - counts, axis=0)
    return sums / np.sqrt(counts, dtype=np.float32)[:, None]


def _forward(p: dict, inputs: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Values of windows. inputs: per direction what each word type sends into the gates; ids and mask: windows x WINDOW."""
    n, steps = ids.shape
    hidden = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((n, steps, 2 * HIDDEN), np.float32)
    trace = []
    for t in range(steps):
        back = steps - 1 - t
        sent = np.stack([inputs[0][ids[:, t]], inputs[1][ids[:, back]]])
        live = np.stack([mask[:, t], mask[:, back]])[:, :, None]
        own = hidden @ p["across"]
        gates = _sigmoid(sent[..., : 2 * HIDDEN] + own[..., : 2 * HIDDEN])
        stay, reset = gates[..., :HIDDEN], gates[..., HIDDEN:]
        fresh = np.tanh(sent[..., 2 * HIDDEN :] + reset * own[..., 2 * HIDDEN :])
        moved = live * (1 - stay)
        before, hidden = hidden, hidden + moved * (fresh - hidden)
        states[:, t, :HIDDEN], states[:, back, HIDDEN:] = hidden[0], hidden[1]
        if keep:
            trace.append((before, own[..., 2 * HIDDEN :], stay, reset, fresh, moved, live))
    looked = np.tanh(states @ p["look"])
    asked = np.where(mask, looked @ p["ask"], np.float32(-1e9))
    share = np.exp(asked - asked.max(axis=1, keepdims=True)) * mask
    share /= np.maximum(share.sum(axis=1, keepdims=True), np.float32(1e-9))
    pooled = (share[:, None, :] @ states)[:, 0]
    values = pooled @ p["weigh"] + p["level"][0]
    return (values, (states, looked, share, pooled, trace)) if keep else values


def _backward(p: dict, kept: tuple, error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters, and of what each word of each window sent, from the gradient of the windows' values."""
    states, looked, share, pooled, trace = kept
    n, steps, _ = states.shape
    grad = {"weigh": error @ pooled, "level": error.sum(keepdims=True)}
    d_pooled = error[:, None] * p["weigh"]
    d_share = (states @ d_pooled[:, :, None])[:, :, 0]
    d_asked = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
    grad["ask"] = np.einsum("nt,nta->a", d_asked, looked)
    d_looked = d_asked[:, :, None] * p["ask"] * (1 - looked**2)
    grad["look"] = states.reshape(n * steps, -1).T @ d_looked.reshape(n * steps, -1)
    d_states = share[:, :, None] * d_pooled[:, None, :] + d_looked @ p["look"].T
    d_hidden = np.zeros((2, n, HIDDEN), np.float32)
    d_sent = np.zeros((2, n, steps, 3 * HIDDEN), np.float32)
    grad["across"] = np.zeros_like(p["across"])
    across_back = p["across"].transpose(0, 2, 1)
    for t in reversed(range(steps)):
        back = steps - 1 - t
        before, own, stay, reset, fresh, moved, live = trace[t]
        d_hidden = d_hidden + np.stack([d_states[:, t, :HIDDEN], d_states[:, back, HIDDEN:]])
        d_fresh = d_hidden * moved * (1 - fresh**2)
        d_stay = -d_hidden * (fresh - before) * live * stay * (1 - stay)
        d_reset = d_fresh * own * reset * (1 - reset)
        d_own = np.concatenate([d_stay, d_reset, d_fresh * reset], axis=2)
        sent = np.concatenate([d_stay, d_reset, d_fresh], axis=2)
        d_sent[0, :, t], d_sent[1, :, back] = sent[0], sent[1]
        grad["across"] += before.transpose(0, 2, 1) @ d_own
        d_hidden = d_hidden * (1 - moved) + d_own @ across_back
    return grad, d_sent


def _sums_by(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[first], np.add.reduceat(rows[order], first, axis=0)


# --- learning ------------------------------------------------------------------------------------


@dataclass
class Toxicity:
    """Without parameters (labels of one kind only, or none) every text scores `share`, that of toxic rows learned from."""

    share: float
    parameters: dict[str, np.ndarray] | None = None
    vocabulary: dict[str, int] | None = None
    slope: float = 1.0
    offset: float = 0.0

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * values.astype(np.float64) + self.offset, -30, 30)))


class _Learner:
    """Windows of the sampled rows as numbers of word types, and the steps that fit the parameters to them."""

    def __init__(self, windows: list[list[str]], labels: list[int], seed: int):
        self.random = np.random.default_rng(seed)
        self.labels = np.array(labels)
        types: dict[str, int] = {}
        held: Counter = Counter()
        ids, owner = [], []
        for row, texts in enumerate(windows):
            seen = set()
            for text in texts:
                numbers = [types.setdefault(w, len(types)) for w in text.split(" ")]
                seen.update(numbers)
                ids.append(numbers + [-1] * (WINDOW - len(numbers)))
                owner.append(row)
            held.update(seen)
        self.mask = np.array(ids) >= 0
        self.ids, self.owner = np.maximum(np.array(ids), 0), np.array(owner)
        names = list(types)
        common = sorted((t for t, n in held.items() if n >= MIN_ROWS), key=lambda t: (-held[t], names[t]))[:VOCABULARY]
        self.vocabulary = {names[t]: i + 1 for i, t in enumerate(common)}
        self.known = np.array([self.vocabulary.get(w, 0) for w in names])
        self.buckets, self.counts = gram_buckets(names)
        self.first = np.cumsum(self.counts) - self.counts
        self.p = _new_parameters(len(self.vocabulary) + 1, self.random)
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items() if k not in ("words", "grams")}
        self.sums = {k: np.full(len(self.p[k]), 1e-6, np.float32) for k in ("words", "grams")}
        self.steps = 0

    def _grams_of(self, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[types]
        offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.buckets[np.repeat(self.first[types], counts) + offsets], counts

    def values(self, which: np.ndarray) -> np.ndarray:
        sent = inputs(self.p, self.known, self.buckets, self.counts)
        parts = [which[i : i + TOGETHER] for i in range(0, len(which), TOGETHER)]
        return np.concatenate([_forward(self.p, sent, self.ids[w], self.mask[w]) for w in parts])

    def step(self, which: np.ndarray, rate: float) -> None:
        types, ids = np.unique(self.ids[which], return_inverse=True)
        ids = ids.reshape(len(which), WINDOW)
        buckets, counts = self._grams_of(types)
        known = np.where(self.random.random(len(types)) < HIDE_WORD, 0, self.known[types])  # some words pass as unknown
        spelled = (self.random.random(len(types)) > HIDE_GRAMS).astype(np.float32)[:, None]  # and some without characters
        given = np.hstack([self.p["words"][known], spelled * _gram_sums(self.p["grams"], buckets, counts)])
        sent = given @ self.p["inward"] + self.p["bias"]
        values, kept = _forward(self.p, sent, ids, self.mask[which], keep=True)
        truth = self.labels[self.owner[which]]
        error = ((_sigmoid(values) - truth) / len(which)).astype(np.float32)
        grad, d_sent = _backward(self.p, kept, error)
        at, d_types = _sums_by(ids.ravel(), d_sent.transpose(1, 2, 0, 3).reshape(ids.size, -1))
        d_types = d_types.reshape(len(at), 2, -1).transpose(1, 0, 2)
        grad["inward"] = given[at].T @ d_types
        grad["bias"] = d_types.sum(axis=1, keepdims=True)
        d_given = (d_types @ self.p["inward"].transpose(0, 2, 1)).sum(axis=0)
        self.steps += 1
        for name, (mean, square) in self.moments.items():
            g = grad[name] + 1e-4 * self.p[name]
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            scale = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
            self.p[name] -= rate * scale * mean / (np.sqrt(square) + 1e-8)
        self._adapt("words", known[at], d_given[:, :WORD_SIZE], VECTOR_RATE * rate)
        share = spelled * d_given[:, WORD_SIZE:] / np.sqrt(counts, dtype=np.float32)[:, None]
        self._adapt("grams", buckets, np.repeat(share, counts, axis=0), VECTOR_RATE * rate)

    def _adapt(self, name: str, index: np.ndarray, rows: np.ndarray, rate: float) -> None:
        rows_at, total = _sums_by(index, rows)
        self.sums[name][rows_at] += (total * total).mean(axis=1)
        self.p[name][rows_at] -= rate * total / np.sqrt(self.sums[name][rows_at])[:, None]

    def fit(self, rows: np.ndarray) -> None:
        """Random windows of every row first; later those that the network takes for the most toxic of their row."""
        inside = np.isin(self.owner, rows)
        windows = np.flatnonzero(inside)
        epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, 3 * len(rows))))
        for epoch in range(epochs):
            chance = self.random.permutation(windows)
            chosen = [_first_of(self.owner[chance], chance, 2)]
            if epoch >= RANDOM_SHARE * epochs:
                top = windows[np.lexsort((windows, -self.values(windows)))]
                best = _first_of(self.owner[top], top, 2)
                clean = chosen[0][self.labels[self.owner[chosen[0]]] == 0]
                chosen = [best, clean]
            batch = self.random.permutation(np.concatenate(chosen))
            rate = 0.01 if epoch < epochs // 2 else 0.004
            for i in range(0, len(batch), BATCH):
                self.step(batch[i : i + BATCH], rate)


def _first_of(owners: np.ndarray, windows: np.ndarray, n: int) -> np.ndarray:
    """The first n windows of every owner, in the given order."""
    order = np.argsort(owners, kind="stable")
    ordered = owners[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    place = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return windows[order[place < n]]


def inputs(p: dict, known: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What word types send into the gates, per direction."""
    given = np.hstack([p["words"][known], _gram_sums(p["grams"], buckets, counts)])
    return given @ p["inward"] + p["bias"]


def _logistic(values: np.ndarray, truth: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression on one value, lightly drawn towards 1 and 0."""
    x = np.stack([values, np.ones_like(values)], axis=1).astype(np.float64)
    b = np.array([1.0, 0.0])
    bound = np.linalg.inv((x * weights[:, None]).T @ x / 4 + 0.5 * np.eye(2))  # of the second derivative: no step overshoots
    for _ in range(500):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b - bound @ (x.T @ (weights * (q - truth)) + 0.5 * (b - [1.0, 0.0]))
    return max(float(b[0]), 0.05), float(b[1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 11) -> Toxicity:
    """Learn from the documents that `labels` (key, label; 1 is toxic) marks. The sample is bounded: at most TOXIC_ROWS and
    CLEAN_ROWS keys with the smallest hashes, and of each at most WINDOWS_A_ROW windows, those with the smallest hashes of
    the whole text's. A key that is labelled several times is toxic if one of its labels says so; null labels and keys count
    for nothing. Repeated documents of a key are taken one by one."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key"))
    marked = marked.agg(F.max((F.col(label) == 1).cast("int")).alias("label"))
    totals = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Toxicity(float(bool(toxic)))
    chance = F.xxhash64("key")
    sample = marked.where("label = 1").orderBy(chance, "key").limit(TOXIC_ROWS).unionByName(
        marked.where("label = 0").orderBy(chance, "key").limit(CLEAN_ROWS))
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("label", T.IntegerType()),
        T.StructField("windows", T.ArrayType(T.StringType())),
    ])
    share = toxic / (toxic + clean)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist() if r["windows"]]
        rows.sort(key=lambda r: (str(r["key"]), r["windows"]))
        model = _learned([r["windows"] for r in rows], np.array([r["label"] for r in rows]), share, seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task learns from the sample, whose bound is above, and sends the parameters back
    sampled = found.mapInArrow(_sampled_windows, schema).repartition(1)
    models = sampled.mapInArrow(learn, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else Toxicity(share)


def _learned(windows: list[list[str]], truth: np.ndarray, share: float, seed: int) -> Toxicity:
    if len(set(truth)) < 2:
        return Toxicity(share)
    learner = _Learner(windows, truth.tolist(), seed)
    apart = np.random.default_rng(seed).permutation(len(windows)) % CALIBRATION == 0
    if len(set(truth[apart])) < 2 or len(set(truth[~apart])) < 2:
        apart = np.ones(len(windows), dtype=bool)  # too few rows to set some apart
        learner.fit(np.arange(len(windows)))
    else:
        learner.fit(np.flatnonzero(~apart))
    own = np.flatnonzero(np.isin(learner.owner, np.flatnonzero(apart)))
    highest = np.full(len(windows), -np.inf)
    np.maximum.at(highest, learner.owner[own], learner.values(own))
    judged = truth[apart]
    weights = np.where(judged == 1, share / judged.mean(), (1 - share) / (1 - judged.mean()))
    slope, offset = _logistic(highest[apart], judged, weights)
    return Toxicity(share, learner.p, learner.vocabulary, slope, offset)


def _sampled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chosen = []
        for number, text in enumerate(batch.column("text").to_pylist()):
            words = words_of(text)
            starts = np.array(window_starts(len(words)), dtype=np.uint64)
            if len(starts) > WINDOWS_A_ROW:
                mixed = (starts + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
                starts = np.sort(starts[np.argsort(mixed, kind="stable")[:WINDOWS_A_ROW]])
            chosen.append([" ".join(words[int(s) : int(s) + WINDOW]) for s in starts])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("label"), pa.array(chosen, pa.list_(pa.string()))],
            names=["key", "label", "windows"],
        )


# --- scoring ------------------------------------------------------------------------------------


class _Scorer:
    """Values of all windows of texts. Words met before keep their inputs, up to KEPT_WORDS of them."""

    def __init__(self, model: Toxicity):
        self.model, self.numbers = model, {}
        self.sent = np.zeros((2, 0, 3 * HIDDEN), np.float32)
        self.room = np.zeros((2, 0, 3 * HIDDEN), np.float32)

    def _learn(self, words: list[str]) -> None:
        known = np.array([self.model.vocabulary.get(w, 0) for w in words])
        new = inputs(self.model.parameters, known, *gram_buckets(words))
        used = self.sent.shape[1]
        if used + len(words) > self.room.shape[1]:
            grown = np.zeros((2, 2 * (used + len(words)), 3 * HIDDEN), np.float32)
            grown[:, :used] = self.sent
            self.room = grown
        self.room[:, used : used + len(words)] = new
        self.sent = self.room[:, : used + len(words)]

    def highest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Value and first word of the highest window of each text; NaN and -1 without a word."""
        words = [words_of(t) for t in texts]
        if len(self.numbers) > KEPT_WORDS:
            self.numbers, self.sent = {}, self.room[:, :0]
        numbers, fresh = self.numbers, []
        ids = []
        for own in words:
            for word in own:
                number = numbers.get(word)
                if number is None:
                    number = numbers[word] = len(numbers)
                    fresh.append(word)
                ids.append(number)
        if fresh:
            self._learn(fresh)
        value, place = np.full(len(texts), np.nan), np.full(len(texts), -1, np.int64)
        if not ids:
            return value, place
        sizes = np.array([len(own) for own in words])
        ends = np.cumsum(sizes)
        counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - STRIDE) // STRIDE)), 0)
        owner = np.repeat(np.arange(len(texts)), counts)
        offset = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
        starts = np.repeat(ends - sizes, counts) + offset
        stops = np.repeat(ends, counts)
        ids = np.array(ids, dtype=np.int64)
        values = np.empty(len(starts), np.float32)
        for i in range(0, len(starts), TOGETHER):
            at = starts[i : i + TOGETHER, None] + np.arange(WINDOW)
            mask = at < stops[i : i + TOGETHER, None]
            values[i : i + TOGETHER] = _forward(
                self.model.parameters, self.sent, ids[np.minimum(at, len(ids) - 1)], mask)
        order = np.lexsort((offset, -values, owner))
        first = order[np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])]
        value[owner[first]], place[owner[first]] = values[first], offset[first]
        return value, place


def scored(docs: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and window (first word of the highest-scoring window, null without one) of every row.

    All windows of the whole text are scored. A text without a letter, null ones too, scores the share of toxic rows that
    the model learned from. Words are runs of letters in lower case. Every row gives one row, repeated rows each their own;
    other columns, whatever their names, are left out, and an empty table gives an empty one.
    """
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType()),
        T.StructField("window", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model) if model.parameters else None
        for batch in batches:
            column = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            pieces = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_BYTES, prepend=0))
            for begin, end in zip([0, *pieces], [*pieces, batch.num_rows]):
                if begin == end:
                    continue
                value, place = np.full(end - begin, np.nan), np.full(end - begin, -1)
                if scorer:
                    value, place = scorer.highest(column.slice(begin, end - begin).to_pylist())
                score = np.where(np.isnan(value), model.share, model.score(np.nan_to_num(value)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(begin, end - begin), pa.array(score, pa.float64()),
                     pa.array(place, pa.int64(), mask=place < 0)],
                    names=["key", "score", "window"],
                )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
