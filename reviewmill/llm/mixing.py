"""Mixing sources to target weights: fixed blocks, multinomial draws per shard, index permutations, a join by index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A source may be repeated up to this many times.
MOST_EPOCHS = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = 11
#: Parts of a source whose documents are put in order side by side.
CHUNKS = 256


@dataclass(frozen=True)
class Mixture:
    """The tables of a mix. Words of a source are numbered through its documents; a block is the words of one number
    divided by the block length.

    sources: source_no, source, source_size, target, blocks, quota (blocks that the mix takes)
    placed: key, source_no, size, first_word (number of the document's first word)
    slots: shard, place (order within the shard), source_no, epoch, block
    """

    sources: DataFrame
    placed: DataFrame
    slots: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """(source_no, block, first_word, begin, words): the words begin, begin + 1, ... of a document lie in a block."""
        first, last = F.col("first_word"), F.col("first_word") + F.col("size") - 1
        n = self.block_words
        block = F.explode(F.sequence((first / n).cast("long"), (last / n).cast("long"))).alias("block")
        cut = self.placed.where("size > 0").select("source_no", "first_word", "size", block)
        begin = F.greatest(F.col("block") * n, first)
        end = F.least((F.col("block") + 1) * n, first + F.col("size"))
        return cut.select("source_no", "block", "first_word", (begin - first).alias("begin"), (end - begin).alias("words"))

    def contents(self) -> DataFrame:
        """Every slot with the document pieces of its block, joined by index: the mixed corpus."""
        return self.slots.join(self.pieces(), ["source_no", "block"])

    def taken(self) -> DataFrame:
        """`placed` with source, source_size, target and `taken`: words of each document in the mix, repeats counted."""
        uses = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
        words = (
            self.pieces().join(uses, ["source_no", "block"]).groupBy("source_no", "first_word")
            .agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
        )
        # documents without words share the number of the next document's first word
        counted = words.withColumn("_counted", F.lit(True))
        found = self.placed.withColumn("_counted", F.when(F.col("size") > 0, True)).join(
            counted, ["source_no", "first_word", "_counted"], "left"
        )
        sources = self.sources.select("source_no", "source", "source_size", "target")
        return found.join(sources, "source_no").select(
            "key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            "source_no", "first_word",
        )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source_no, source, source_size, target) from one row (source, source_size) a source.

    Sources in order of code points, null last, take the weights in turn. Shares by weight sum up to all words; a target
    stops at `most` times its source, and the rest shares the excess by weight until none is above. With sources in order
    of limit / weight, the level that every unlimited source has for each unit of weight is the largest of the levels that
    follow from limiting the sources before it. All sources without words have target 0.

    One row a source is ordered in one task: the number of sources, not of rows, bounds it.
    """
    numbered = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.col("source_no") % len(weights)]
    limit = (F.col("source_size") * most).cast("double")
    weighted = numbered.withColumn("weight", weight).withColumn("limit", limit)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.max("level").over(everything)
    return weighted.withColumn("level", left / rest).withColumn("target", F.least("limit", F.col("weight") * level)).select(
        "source_no", "source", "source_size", "target"
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mixture:
    """Mix all documents so that each source's words come near its target.

    The documents of a source, in order of key and size, form one stream of words that is cut into blocks of `block_words`.
    A source gets a quota of blocks in proportion to its target. Each shard of `shard_slots` slots draws its source
    counts from a multinomial; slots drawn past a source's quota pass to the sources that were drawn too rarely, so every
    quota is met. The n-th slot of a source is block p(n mod blocks) of epoch n div blocks, with p a pseudorandom
    permutation of the indices of that epoch: each epoch takes a block once at most, none more often than `most` times.

    Null and empty texts have size 0 and nothing is taken from them. A null source is a source of its own; null keys come
    first. Repeated rows are separate documents. Empty tables give empty tables. Draws depend on the seed alone. The driver
    sees one row a source. A source's documents are put in order in 256 parts, so a hot source is no single task.
    """
    spark = docs.sparkSession
    sized = stored(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                    F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "sized",
    )
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks")))
    sources = stored(
        totals.withColumn("blocks", blocks).withColumn(
            "quota", F.least(F.coalesce(quota.cast("long"), F.lit(0)), F.col("blocks") * most)
        ),
        "sources",
    )
    chunk = F.pmod(F.xxhash64("key", "size"), F.lit(CHUNKS))
    # the table of sources is written, so Spark weighs it before it broadcasts it
    numbered = sized.join(
        sources.select("source_no", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))
    ).select("key", "size", "source_no", chunk.alias("chunk"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("source_no", "chunk").agg(F.sum("size").alias("n")).select(
        "source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("source_no", "chunk").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(
        numbered.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["source_no", "chunk"])
        .select("key", "source_no", "size", (F.col("offset") + F.col("ahead")).alias("first_word")),
        "placed",
    )
    rows = sources.select("source_no", "blocks", "quota").orderBy("source_no").collect()
    draws = _Draws(np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), shard_slots, seed)
    drawn = spark.range(draws.shards).mapInPandas(draws.counts, "shard long, source_no int, slots long")
    drawn = stored(drawn, "drawn")
    ahead = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = drawn.withColumn("start", F.coalesce(F.sum("slots").over(ahead), F.lit(0)))
    total = {r[0]: r[1] for r in drawn.groupBy("source_no").agg(F.sum("slots")).collect()}
    draws.drawn = np.array([total.get(i, 0) for i in range(len(rows))], np.int64)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, or few rows would share a task
    slots = starts.where("slots > 0").repartition(parts, "shard").mapInPandas(
        draws.slots, "shard long, place long, source_no int, epoch int, block long"
    )
    return Mixture(sources, placed, stored(slots, "slots"), block_words)


def mixed_texts(docs: DataFrame, mixture: Mixture, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `docs` that the mix takes words of, with the words taken as their text.

    A document that an epoch takes whole keeps its text as it is; of others the words taken follow in order, parted by one
    space; epochs are joined by a space. Rows that repeat a key are told apart by source, size and then at random among equals.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).field(text)
            texts = [_chosen_words(t.as_py(), p.as_py()) for t, p in zip(own, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    parts = mixture.contents().groupBy("source_no", "first_word").agg(
        F.array_sort(F.collect_list(F.struct("epoch", "begin", "words"))).alias("parts")
    )
    taken = mixture.placed.where("size > 0").join(parts, ["source_no", "first_word"]).join(
        mixture.sources.select("source_no", F.col("source").alias("_source")), "source_no"
    )
    number = F.row_number().over(Window.partitionBy("_key", "_source", "_size").orderBy("_order"))
    taken = taken.select(F.col("key").alias("_key"), "_source", F.col("size").alias("_size"), F.col("first_word").alias("_order"), "parts")
    taken = taken.withColumn("_number", number)
    whole = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("_key"), F.col(source).alias("_source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"), F.xxhash64(text).alias("_order"),
    ).withColumn("_number", number)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("_key", "_source", "_size", "_number")]
    joined = whole.alias("d").join(taken.alias("t"), same).select("d.row", "t.parts")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(rows, f"row {kind}, text string").select(
        *[(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def _chosen_words(text: str, parts: list[dict]) -> str:
    words = re.findall(WORD, text)
    epochs: dict[int, list[str]] = {}
    for part in parts:
        epochs.setdefault(part["epoch"], []).extend(words[part["begin"]: part["begin"] + part["words"]])
    return " ".join(text if len(own) == len(words) else " ".join(own) for own in epochs.values())


class _Draws:
    """The draws of the shards; holds a few numbers a source."""

    def __init__(self, blocks: np.ndarray, quota: np.ndarray, shard_slots: int, seed: int):
        self.blocks, self.quota, self.shard_slots, self.seed = blocks, quota, shard_slots, seed
        self.total = int(quota.sum())
        self.shards = -(-self.total // shard_slots)
        self.drawn = quota

    def counts(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                slots = min(self.shard_slots, self.total - shard * self.shard_slots)
                drawn = np.random.default_rng([self.seed, shard]).multinomial(slots, self.quota / self.total)
                yield pd.DataFrame({"shard": shard, "source_no": np.arange(len(drawn)), "slots": drawn})

    def slots(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        excess = np.cumsum(np.maximum(self.drawn - self.quota, 0))
        short = np.cumsum(np.maximum(self.quota - self.drawn, 0))
        for frame in frames:
            for shard, source, n, start in zip(frame["shard"], frame["source_no"], frame["slots"], frame["start"], strict=True):
                number = start + np.arange(n)
                kept = number[number < self.quota[source]]
                yield self._chosen(shard, source, kept)
                if len(kept) < n:
                    over = (excess[source - 1] if source else 0) + number[len(kept):] - self.quota[source]
                    to = np.searchsorted(short, over, "right")
                    spare = self.drawn[to] + over - np.where(to > 0, short[to - 1], 0)
                    for other in np.unique(to):
                        yield self._chosen(shard, other, spare[to == other])

    def _chosen(self, shard: int, source: int, number: np.ndarray) -> pd.DataFrame:
        epoch, index = np.divmod(number, max(int(self.blocks[source]), 1))
        block = np.empty_like(index)
        for e in np.unique(epoch):
            block[epoch == e] = permuted(index[epoch == e], int(self.blocks[source]), (self.seed, int(source), int(e)))
        place = _mixed(number.astype(np.uint64), _key((self.seed, int(shard), int(source)))) >> np.uint64(1)
        return pd.DataFrame({"shard": shard, "place": place.astype(np.int64), "source_no": np.int32(source),
                             "epoch": epoch.astype(np.int32), "block": block})


def permuted(index: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """The images of `index` under a pseudorandom permutation of 0 .. n - 1: a Feistel network, walked until in range."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [_key((*key, r)) for r in range(4)]
    out, outside = index.astype(np.uint64), np.arange(len(index))
    while len(outside):
        value = out[outside]
        left, right = value >> half, value & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & mask)
        out[outside] = left << half | right
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def _key(parts: tuple[int, ...]) -> np.uint64:
    return np.random.SeedSequence(parts).generate_state(1, np.uint64)[0]


def _mixed(values: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 64-bit mix of values and key: multiplications by odd numbers and shifts."""
    with np.errstate(over="ignore"):
        x = (values + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)
