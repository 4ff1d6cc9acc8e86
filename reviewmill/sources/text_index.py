"""Substring search that opens only the files which may hold the text.

Beside a Parquet table lies an index with a row a file: a Bloom filter of all runs of three characters in the lower-cased
texts of the file. A text that holds the wanted string holds all its runs, so a file whose filter lacks one is not opened;
the others are searched as without an index, and the rows are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bits of a file's filter, a power of two, and bits set for each run of characters.
FILTER_BITS, FUNCTIONS, RUN = 1 << 20, 3, 3

_SCHEMA = "file string, bits binary"


def _places(text: str) -> np.ndarray:
    """Bits of all runs of RUN code points of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < RUN:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(len(codes) - RUN + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(RUN):
            mixed = (mixed ^ codes[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        second = mixed * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32) | np.uint64(1)
        found = [(mixed + np.uint64(i) * second) >> np.uint64(7) & np.uint64(FILTER_BITS - 1) for i in range(FUNCTIONS)]
    return np.concatenate(found)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for every file that a task has read something of."""
    now, held = None, None
    for batch in batches:
        for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
            if file != now:
                if now is not None:
                    yield _row(now, held)
                now, held = file, np.zeros(FILTER_BITS, bool)
            if text:
                held[_places(text)] = True
    if now is not None:
        yield _row(now, held)


def _row(file: str, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([file]), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["file", "bits"])


def _united(parts: pd.DataFrame) -> pd.DataFrame:
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in parts["bits"]])
    return pd.DataFrame({"file": [parts["file"].iloc[0]], "bits": [bits.tobytes()]})


def write_text_index(spark: SparkSession, table: str, index: str, text: str = "text") -> None:
    """Index the files of the Parquet table, in one pass over its texts. NULL and short texts set no bit."""
    rows = spark.read.parquet(table).select(F.col("_metadata.file_path").alias("file"), F.lower(text).alias("text"))
    united = rows.mapInArrow(_filters, _SCHEMA).groupBy("file").applyInPandas(_united, _SCHEMA)
    united.write.mode("overwrite").parquet(index)


def matching_files(spark: SparkSession, table: str, index: str, wanted: str) -> list[str]:
    """Files of the table that may hold the string in some letter case: those whose filter has all its runs, and those that
    the index does not know, as they came later. A string shorter than a run may be in any file."""
    places = _places(wanted.lower())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.frombuffer(b, np.uint8) for b in batch.column("bits").to_pylist()]
            may = [bool((b[places >> 3] >> (7 - (places & 7)) & 1).all()) for b in bits]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(may)], names=["file", "may"])

    places = places.astype(np.int64)
    known = {r["file"]: r["may"] for r in spark.read.parquet(index).mapInArrow(kept, "file string, may boolean").collect()}
    plain = {_plain(file): may for file, may in known.items()}
    return [f for f in spark.read.parquet(table).inputFiles() if plain.get(_plain(f), True)]


def _plain(file: str) -> str:
    """Spark writes one slash or three after the scheme."""
    scheme, mark, rest = file.partition(":/")
    return f"{scheme}:/{rest.lstrip('/')}" if mark else file


def search_text(spark: SparkSession, table: str, index: str, wanted: str, text: str = "text") -> DataFrame:
    """The rows of the table whose text holds the string in any letter case, as a plain substring. A blank string, as in the
    explorer, narrows nothing."""
    everything = spark.read.parquet(table)
    if not wanted.strip():
        return everything
    files = matching_files(spark, table, index, wanted)
    rows = spark.read.schema(everything.schema).parquet(*files) if files else everything.limit(0)
    return rows.where(F.lower(text).contains(wanted.lower()))
