"""CSV whose quoted values span lines, read by many tasks.

Spark deals a file out line by line, in splits. What a line does to the question "inside a quoted value or not" is a function
of the answer before it, and so is what a whole split does: one row a split comes to the driver, which puts the functions one
after the other and knows how every split begins. Then each split joins its own lines to records; only a record that
crosses a split's edge is put together across tasks. Spark's CSV expression parses the records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A field from its first character on, with the delimiter behind it: quoted, with what may follow the quote, or plain. A
#: quote inside a plain field is a character like any other.
_FIELD = re.compile(r'(?:"(?:[^"]|"")*(?:"(?!")[^,]*|(?P<open>\Z))|[^",][^,]*|)(?:,|\Z)')
_REST = re.compile(r'(?:[^"]|"")*"(?!")[^,]*(?:,|\Z)')


def after(line: str, inside: bool) -> bool:
    """Is the end of the line inside a quoted value, if its beginning is or is not?"""
    at = 0
    if inside:
        rest = _REST.match(line)
        if rest is None:
            return True
        at = rest.end()
        if not line[:at].endswith(","):
            return False
    while at < len(line):
        field = _FIELD.match(line, at)
        if field.group("open") is not None:
            return True
        at = field.end()
    return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """(file, start) and some of its lines, in order."""
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()))
        lines, begin = batch.column("line").to_pylist(), 0
        for key, rows in groupby(keys):
            end = begin + sum(1 for _ in rows)
            yield key, lines[begin:end]
            begin = end


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a split: whether its end is inside a quoted value, if its beginning is not (plain) or is (quoted), whether one of
    its lines begins outside of one in either case, and whether its first line ends with a carriage return."""
    now, ends, outside, returns = None, [False, True], [False, False], False

    def done() -> pa.RecordBatch:
        columns = [now[0], now[1], *ends, *outside, returns]
        names = ["file", "start", "plain", "quoted", "opens_plain", "opens_quoted", "returns"]
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=names)

    for key, lines in _splits(batches):
        if key != now:
            if now is not None:
                yield done()
            now, ends, outside, returns = key, [False, True], [False, False], lines[0].endswith("\r")
        for line in lines:
            outside = [o or not e for o, e in zip(outside, ends)]
            if '"' in line:
                ends = [after(line.removesuffix("\r"), e) for e in ends]
    if now is not None:
        yield done()


_EFFECT = ("file string, start bigint, plain boolean, quoted boolean, opens_plain boolean, opens_quoted boolean, "
           "returns boolean")


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, first (is it the file's first record?), record: the records of all files, as text. Line ends inside quoted values
    are line feeds where the file's own lines end so or with a carriage return before it. Empty lines are no records."""
    effects = _lines(spark, path).mapInArrow(_effects, _EFFECT).collect()
    begins: dict[tuple[str, int], tuple[bool, int, bool]] = {}  # inside, start of the split that holds the record's beginning, returns
    for file, rows in groupby(sorted(effects, key=lambda r: (r["file"], r["start"])), key=lambda r: r["file"]):
        inside, owner, returns = False, 0, None
        for row in rows:
            returns = row["returns"] if returns is None else returns
            begins[file, row["start"]] = (inside, owner, returns)
            if row["opens_quoted" if inside else "opens_plain"]:
                owner = row["start"]
            inside = row["quoted" if inside else "plain"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose owner is NULL are whole records; the others are pieces of the last record that begins in the owner."""
        now, inside, owner, returns, held, first = None, False, None, False, [], False

        def row(last: bool) -> list[tuple]:
            # the last record of a split may go on in the next one
            whole = owner is None and not (last and inside)
            return [(now[0], now[1], None if whole else (now[1] if owner is None else owner), first, "\n".join(held))] if held else []

        for key, lines in _splits(batches):
            out = []
            if key != now:
                if now is not None:
                    out += row(True)
                now = key
                inside, owner, returns = begins[key]
                owner, held, first = (owner if inside else None), [], key[1] == 0
            for line in lines:
                if not inside and held:
                    out += row(False)
                    held, owner, first = [], None, False
                line = line.removesuffix("\r") if returns else line
                held.append(line)
                if '"' in line:
                    inside = after(line, inside)
            if out:
                yield _batch(out)
        if now is not None and held:
            yield _batch(row(True))

    found = _lines(spark, path).mapInArrow(
        join, "file string, start bigint, owner bigint, first boolean, record string")
    pieces = found.where("owner IS NOT NULL").groupBy("file", "owner").agg(
        F.bool_or("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n").alias("record"))
    whole = found.where("owner IS NULL").select("file", "first", "record")
    return whole.unionByName(pieces.select("file", "first", "record")).where("record <> ''")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, start, owner, first, text = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.string()), pa.array(start, pa.int64()), pa.array(owner, pa.int64()), pa.array(first, pa.bool_()),
         pa.array(text, pa.string())], names=["file", "start", "owner", "first", "record"])


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The values of all records but each file's first one, its header, as strings."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    parsed = records(spark, path).where("NOT first").select(
        F.from_csv("record", F.lit(schema), {"quote": '"', "escape": '"'}).alias("r"))
    return parsed.select("r.*")
