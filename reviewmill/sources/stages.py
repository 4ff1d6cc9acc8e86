"""Stage tables: results kept under a fingerprint of the input and the parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill.operators.scale import delete_path, path_exists

FINGERPRINT_CHARS = 12
#: Files up to this size are hashed whole, larger ones in ranges.
LEAF_BYTES = 64 << 20
_PRIMES, _BASES, _CHUNK = (2147483647, 2147483629, 2147483587, 2147483579), (48271, 69621, 39373, 16807), 4096
_POWERS = np.array([[pow(b, i, p) for b, p in zip(_BASES, _PRIMES)] for i in reversed(range(_CHUNK))], dtype=np.float64)

CLEAN, CLEAN_STATS = "01_clean", "01_clean_stats"
SCORED, SPAM_STATS = "02_scored", "02_spam_stats"
MEMBERS, CLUSTERS, CLUSTER_STATS = "03_members", "03_clusters", "03_cluster_stats"
TERM_COUNTS, TOPIC_CALLS, TOPICS = "04_term_counts", "04_topic_calls", "04_topics"
ISSUE_CALLS, NEGATIVES = "05_issue_calls", "05_negatives"
KPIS = "06_kpis"
LANGUAGES, REPAIR_EXAMPLES = "01_lang_distribution", "01_repair_examples"
FLAGS, COST_BY_STEP = "02_flags", "06_cost_by_step"
RESULTS = [CLEAN, CLEAN_STATS, LANGUAGES, REPAIR_EXAMPLES, SCORED, FLAGS, SPAM_STATS, MEMBERS,
           CLUSTERS, CLUSTER_STATS, TOPICS, NEGATIVES, KPIS, COST_BY_STEP]
# in the order of their making
ALL_STAGES = [CLEAN, LANGUAGES, REPAIR_EXAMPLES, CLEAN_STATS, SCORED, FLAGS, SPAM_STATS, MEMBERS,
              CLUSTERS, CLUSTER_STATS, TERM_COUNTS, TOPIC_CALLS, TOPICS, ISSUE_CALLS, NEGATIVES,
              KPIS, COST_BY_STEP]


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """First characters of the SHA-1 of a file's bytes; of the sorted file digests for a folder.

    A file over LEAF_BYTES is read in ranges by many tasks; its digest is that of its length and of hashes of the ranges,
    which add up to the same whatever the ranges are.
    """
    files = spark.read.format("binaryFile").load(path)
    digests = [r[0] for r in files.where(F.col("length") <= LEAF_BYTES).select(F.sha1("content")).collect()]
    large = files.where(F.col("length") > LEAF_BYTES).select("path", "length").collect()
    if large:
        digests += _range_digests(spark, {r["path"]: r["length"] for r in large})
    digests.sort()
    if len(digests) == 1:
        return digests[0][:FINGERPRINT_CHARS]
    return hashlib.sha1("".join(digests).encode()).hexdigest()[:FINGERPRINT_CHARS]


def _range_digests(spark: SparkSession, sizes: dict[str, int]) -> list[str]:
    """Digests of large files. The hash of bytes b is the sum of b[i] * base ** (n - 1 - i) modulo a prime, for four bases and
    primes: that of two ranges in a row is hash(first) * base ** length(second) + hash(second). Spark deals the files out
    line by line, and a range is what one split holds; only its hashes come to the driver."""
    lines = spark.read.option("lineSep", "\n").text(list(sizes)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    schema = "file string, size bigint, start bigint, length bigint, hashes array<bigint>"
    ranges: dict[str, list] = {}
    for row in lines.mapInArrow(_hash_ranges, schema).collect():
        ranges.setdefault(row["file"], []).append(row)
    out = []
    for found in ranges.values():
        whole = [0] * len(_PRIMES)
        for row in sorted(found, key=lambda r: r["start"]):
            whole = [
                (h * pow(b, row["length"], p) + own) % p for h, own, b, p in zip(whole, row["hashes"], _BASES, _PRIMES)
            ]
        # every line counts with a line end; the length tells whether the last one has it
        out.append(hashlib.sha1(repr((found[0]["size"], whole)).encode()).hexdigest())
    return out


def _hash_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, length, hashes = None, 0, [0] * len(_PRIMES)
    jump = [pow(b, _CHUNK, p) for b, p in zip(_BASES, _PRIMES)]

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([now[2]], pa.int64()),
             pa.array([length], pa.int64()), pa.array([hashes], pa.list_(pa.int64()))],
            names=["file", "size", "start", "length", "hashes"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("file", "size", "start"))))
        texts = batch.column("line").to_pylist()
        begin = 0
        for key, rows in groupby(keys):
            end = begin + sum(1 for _ in rows)
            if now is not None and key != now:
                yield done()
                length, hashes = 0, [0] * len(_PRIMES)
            now = key
            data = b"\n".join(texts[begin:end]) + b"\n"
            length += len(data)
            # whole chunks at a time; the first piece is what is over
            head = len(data) % _CHUNK
            numbers = np.frombuffer(data, np.uint8).astype(np.float64)
            for piece, step in ((numbers[:head], None), (numbers[head:], jump)):
                if not len(piece):
                    continue
                size = head if step is None else _CHUNK
                # sums of products below 2 ** 52 are exact
                values = (piece.reshape(-1, size) @ _POWERS[_CHUNK - size :]).astype(np.int64).tolist()
                shift = step or [pow(b, head, p) for b, p in zip(_BASES, _PRIMES)]
                for row in values:
                    hashes = [(h * j + v) % p for h, j, v, p in zip(hashes, shift, row, _PRIMES)]
            begin = end
    if now is not None:
        yield done()


def table_fingerprint(df: DataFrame, *parameters) -> str:
    """Fingerprint of the rows, in any order and partitioning, and of the parameters."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    parts = df.agg(
        F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.hash(h))
    ).first()
    return combined_fingerprint(sorted(df.columns), tuple(map(str, parts)), parameters)


def combined_fingerprint(*parts) -> str:
    return hashlib.sha1(repr(parts).encode()).hexdigest()[:FINGERPRINT_CHARS]


class StageStore:
    """Parquet tables in <root>/<fingerprint>/<stage>.

    A stage counts as done once its marker exists; the marker is written after the table, so a
    run that died half-way is repeated.
    """

    def __init__(self, spark: SparkSession, root: str, fingerprint: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{fingerprint}"
        self.reused: list[str] = []

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}"

    def done(self, stage: str) -> bool:
        return path_exists(self.spark, f"{self.folder}/{stage}.done/_SUCCESS")

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage))

    def write(
        self, stage: str, df: DataFrame, check: Callable[[DataFrame], object] | None = None
    ) -> DataFrame:
        """Store a table. A check that raises leaves the stage not done.

        The markers of the stage and of all later ones go first: a write that fails half-way leaves
        none of them done, so a later run mixes no old tables with new ones.
        """
        later = ALL_STAGES[ALL_STAGES.index(stage):] if stage in ALL_STAGES else [stage]
        for name in later:
            delete_path(self.spark, f"{self.folder}/{name}.done")
        df.write.mode("overwrite").parquet(self.path(stage))
        if check is not None:
            check(self.read(stage))
        marker = self.spark.range(1).select(F.lit(stage).alias("value"))
        marker.coalesce(1).write.mode("overwrite").text(f"{self.folder}/{stage}.done")
        return self.read(stage)

    def stage(
        self, name: str, compute: Callable[[], DataFrame], force: bool = False,
        check: Callable[[DataFrame], object] | None = None,
    ) -> DataFrame:
        """The stored table, computed first where it is absent or force is set."""
        if not force and self.done(name):
            self.reused.append(name)
            return self.read(name)
        return self.write(name, compute(), check)


def load_results(store: StageStore) -> dict[str, DataFrame | None] | None:
    """All result tables, None for those absent; None altogether without the clean table."""
    if not store.done(CLEAN):
        return None
    return {name: store.read(name) if store.done(name) else None for name in RESULTS}
