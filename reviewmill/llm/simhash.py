"""SimHash fingerprints and their near copies by covering locality-sensitive hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.components import connected
from reviewmill.llm.scratch import stored

BITS = 64
SEED = 42
RADIUS = 4
#: Rows of a bucket that are compared with one another; larger buckets are hashed again by their other bits.
BUCKET_ROWS = 512
#: Bytes of a text that are split into words at once.
PIECE_BYTES = 1 << 20
_LOWEST_BITS = np.uint64(0x0101010101010101)
_SPACE = re.compile(rb"[ \t-\r]")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, print): the SimHash of every whole text as a long.

    Words are runs of anything but ASCII white space, A-Z lowered; shingles keep repeats. A text with fewer
    words than a shingle is one shingle, one without words (or null) has print 0. Long texts are taken in pieces,
    so memory does not grow with them. Rows that repeat a key each get their own row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(
                (_fingerprint((t.as_py() or "").encode(), shingle) for t in batch.column(1)), np.uint64, len(batch)
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["key", "print"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        rows, f"key {kind}, print bigint"
    )


def _fingerprint(data: bytes, shingle: int) -> int:
    counts, total, kept = np.zeros(BITS, np.int64), 0, []
    for words in _pieces(data.lower()):
        words = kept + words
        if len(words) >= shingle:
            hashes = _shingle_hashes(words, shingle)
            counts += _bit_counts(hashes)
            total += len(hashes)
        kept = words[-(shingle - 1):] if shingle > 1 else []
    if not total and kept:
        counts, total = _bit_counts(_shingle_hashes(kept, len(kept))), 1
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    start = 0
    while start < len(data):
        space = _SPACE.search(data, start + PIECE_BYTES)
        end = space.start() if space else len(data)
        yield data[start:end].split()
        start = end


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(words) - shingle + 1, xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[shingle - 1:].tolist(), strict=True)],
        np.uint64,
    )


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit: eight counters in the bytes of a word, for 255 hashes at a time."""
    counts, starts = np.zeros(BITS, np.int64), np.arange(0, len(hashes), 255)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LOWEST_BITS, starts)
        counts[bit::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return counts


def covering_masks(fixed: int, radius: int) -> list[int]:
    """Masks over the bits that `fixed` leaves free, each united with `fixed`.

    Every free bit gets a vector of radius + 1 bits other than zero. There is a mask for each such vector v: the bits
    whose vectors have an odd product with v. Any `radius` bits leave some v with even products to all of them, so
    two prints that differ in at most that many free bits agree under some mask: no pair within the radius is lost.
    """
    vectors = sorted(range(1, 1 << (radius + 1)), key=int.bit_count)  # unit vectors first: every mask takes a free bit
    free = [b for b in range(BITS) if not fixed >> b & 1]
    return [
        fixed | sum(1 << b for i, b in enumerate(free) if (v & vectors[i % len(vectors)]).bit_count() & 1)
        for v in vectors
    ]


def near_links(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links that join all distinct longs of column `print` differing in `radius` bits or fewer.

    Prints meet in the buckets of the covering masks. A bucket of up to `bucket_rows` prints is compared within and
    yields a forest, not all pairs. A larger one streams through in one pass and its rows are hashed again by covering
    masks over the bits that its mask leaves free. Each level leaves fewer of them, half at first, until a bucket
    cannot be large: 8 bits make 256 prints. Nothing is capped, and a task holds one small bucket at a time.
    """
    if not 1 <= radius <= 6:
        raise ValueError("the radius is from 1 to 6")
    spark, found, hot = prints.sparkSession, None, prints.select("print", F.lit(0).cast("long").alias("mask"))
    bucket_rows = max(bucket_rows, 256)
    while hot is not None:
        hashed = hot.mapInArrow(_Hashed(radius), "mask bigint, print bigint")
        bucket = F.col("print").bitwiseAND(F.col("mask"))
        level = stored(
            hashed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mask", bucket)
            .sortWithinPartitions("mask", bucket)
            .mapInArrow(_Linked(radius, bucket_rows), "mask bigint, a bigint, b bigint"),
            "near-links",
        )
        links = level.where("mask is null").select("a", "b")
        found = links if found is None else found.unionByName(links)
        large = level.where("mask is not null").select(F.col("a").alias("print"), "mask")
        hot = None if large.isEmpty() else large
    return found.distinct()


class _Hashed:
    """Each print once per covering mask."""

    def __init__(self, radius: int):
        self.radius, self.masks = radius, {}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, fixed = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for mask in np.unique(fixed).tolist():
                own = prints[fixed == mask]
                masks = self.masks.get(mask)
                if masks is None:
                    masks = np.array(covering_masks(mask & (1 << BITS) - 1, self.radius), np.uint64).view(np.int64)
                    self.masks[mask] = masks
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(masks, len(own))), pa.array(np.tile(own, len(masks)))], ["mask", "print"]
                )


class _Linked:
    """Links within the small buckets of a sorted partition; the rows of large ones pass through with their mask."""

    def __init__(self, radius: int, bucket_rows: int):
        self.radius, self.bucket_rows = radius, bucket_rows

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = prints = np.empty(0, np.int64)
        large = None
        for batch in batches:
            masks = np.concatenate([masks, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False)])
            starts = self._starts(masks, prints)
            last = int(starts[-1])
            # the last bucket may go on in the next batch
            keep = len(prints) - last <= self.bucket_rows and (masks[-1], prints[-1] & masks[-1]) != large
            cut = last if keep else len(prints)
            yield from self._buckets(masks[:cut], prints[:cut], starts[starts < cut], large)
            large = None if keep else (masks[-1], prints[-1] & masks[-1])
            masks, prints = masks[cut:], prints[cut:]
        if len(prints):
            yield from self._buckets(masks, prints, self._starts(masks, prints), large)

    @staticmethod
    def _starts(masks: np.ndarray, prints: np.ndarray) -> np.ndarray:
        keys = prints & masks
        return np.flatnonzero(np.concatenate(([True], (masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1]))))

    def _buckets(self, masks, prints, starts, large) -> Iterator[pa.RecordBatch]:
        if not len(prints):
            return
        sizes = np.diff(np.append(starts, len(prints)))
        hot = sizes > self.bucket_rows
        if large is not None and (masks[0], prints[0] & masks[0]) == large:
            hot[0] = True
        out = [(masks[np.repeat(hot, sizes)], prints[np.repeat(hot, sizes)], None)]
        two = starts[(sizes == 2) & ~hot]
        near = np.bitwise_count((prints[two] ^ prints[two + 1]).view(np.uint64)) <= self.radius
        out.append((None, prints[two[near]], prints[two[near] + 1]))
        for i in np.flatnonzero((sizes > 2) & ~hot).tolist():
            own = prints[starts[i]: starts[i] + sizes[i]]
            root = forest(np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= self.radius)
            linked = np.flatnonzero(root != np.arange(len(own)))
            out.append((None, own[linked], own[root[linked]]))
        for mask, a, b in out:
            if len(a):
                nothing = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [nothing if mask is None else pa.array(mask), pa.array(a), nothing if b is None else pa.array(b)],
                    ["mask", "a", "b"],
                )


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest row that a chain of true cells leads to."""
    root = np.arange(len(near))
    while True:
        lower = np.where(near, root[None, :], len(near)).min(1)
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4,
                radius: int = RADIUS) -> DataFrame:
    """(key, print, component): every row's fingerprint and the smallest key of its component.

    Texts with equal prints are one node of the graph, so thousands of copies cost one row. Keys that are null
    have their component too; it is null only where no row of the component has a key. Repeated rows share everything.
    An empty table gives no rows; other columns of `docs` are not read.
    """
    prints = stored(fingerprints(docs, key, text, shingle), "prints")
    nodes = stored(prints.groupBy("print").agg(F.min("key").alias("first")), "print-nodes")
    roots = connected(near_links(nodes, radius), "a", "b")
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    component = rooted.join(smallest, "root").select("print", "component")
    return prints.join(component, "print").select("key", "print", "component")
