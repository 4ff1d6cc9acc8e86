"""WARC archives: written as whole-file gzip streams, normalised to a member per record with an offset index, read back."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.scratch import located, new_path, stored

#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: An archive is closed once it holds this many bytes of records.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
STREAM_LEVEL = 1
MEMBER_LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header lines of one record may not be longer; beyond it the file is no WARC.
HEADER_BYTES = 1 << 20
_GZIP = 31
_BREAKS = re.compile(r"[\x00-\x20\x7f%]")
_PERCENT = re.compile(r"%([0-9A-F]{2})")


def decided(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
            least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): what each page's record will be.

    Of equal payloads of `least` bytes or more, the smallest key is the response; rows with a larger or null key revisit
    it. Rows that repeat that key, and payloads that have null keys alone, are responses. A null payload is empty.
    Digests are counted before the join, so only payloads that repeat meet, however often one repeats; their table is
    written, so Spark knows its size when it picks the join, and pages need not move where few payloads repeat.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        text.alias("payload"), F.sha2(text, 256).alias("digest"))
    digests = pages.select(F.col(key).cast("long").alias("page_id"), F.sha2(text, 256).alias("digest"),
                           F.octet_length(text).alias("bytes"))
    first = (
        digests.where(F.col("bytes") >= least).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select("digest", "first")
    )
    return rows.join(stored(first, "repeated-payloads"), "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `decided` rows as WARC files, each one gzip stream; returns (archive, records).

    Every attempt of a task writes files of its own name, and only those of the attempts that count are listed, so a lost
    executor or a second attempt leaves no half-written archive in the list. The list is itself a written table.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                out = out or _Archive(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                out.add(record(row))
                if out.written >= size:
                    yield out.closed()
                    out = None
        if out:
            yield out.closed()

    return stored(records.mapInArrow(write, "archive string, records long"), "archives")


class _Archive:
    """A WARC file written as one gzip stream."""

    def __init__(self, uri: str):
        self.uri, self.file = uri, _store(uri)[0].open_output_stream(_store(uri)[1], compression=None)
        self.deflate, self.written, self.records = zlib.compressobj(STREAM_LEVEL, zlib.DEFLATED, _GZIP), 0, 0

    def add(self, data: bytes) -> None:
        self.file.write(self.deflate.compress(data))
        self.written += len(data)
        self.records += 1

    def closed(self) -> pa.RecordBatch:
        self.file.write(self.deflate.flush())
        self.file.close()
        return pa.RecordBatch.from_arrays([pa.array([self.uri]), pa.array([self.records], pa.int64())], ["archive", "records"])


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    store, path = located(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store, path


def record(row: dict) -> bytes:
    """One record: a response with its payload, or a revisit with headers only. White space in URLs is percent-encoded."""
    payload = row["payload"].encode()
    revisit = row["refers_to"] is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{row["page_id"]}').urn}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
    ]
    if row["page_id"] is not None:
        lines.append(f"Page-Number: {row['page_id']}")
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + _BREAKS.sub(lambda c: f"%{ord(c.group()):02X}", row["url"]))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page: {row['refers_to']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def normalise(archives: DataFrame, folder: str, archive: str = "archive") -> DataFrame:
    """Rewrite gzip streams of any layout with every record as a member of its own; returns the index.

    (archive, offset, length): where each record's member begins in its new file and how long it is. A file is inflated
    once, front to back, in bounded pieces; a record passes through in pieces too. The same numbers are written beside
    the new file, a line each, in `<archive>.idx`. A stream that ends inside a record raises an error.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                store, path = located(source)
                out_store, out_path = _store(target)
                offsets, lengths, at = [], [], 0
                with store.open_input_stream(path, compression=None) as file, out_store.open_output_stream(
                    out_path, compression=None
                ) as out:
                    for member in members(_inflated(file)):
                        length = sum(out.write(part) for part in member)
                        offsets.append(at)
                        lengths.append(length)
                        at += length
                with out_store.open_output_stream(f"{out_path}.idx", compression=None) as index:
                    index.write("".join(f"{o} {n}\n" for o, n in zip(offsets, lengths, strict=True)).encode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([target] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    ["archive", "offset", "length"],
                )

    few = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = archives.select(archive).repartition(few, archive)
    return stored(spread.mapInArrow(rewrite, "archive string, offset long, length long"), "index")


def _inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members."""
    inflate, fresh = zlib.decompressobj(_GZIP), True
    while data := file.read(CHUNK):
        while data:
            part, fresh = inflate.decompress(data, CHUNK), False
            if part:
                yield part
            if inflate.eof:
                data, inflate, fresh = inflate.unused_data, zlib.decompressobj(_GZIP), True
            else:
                data = inflate.unconsumed_tail
    while not fresh and (part := inflate.flush()):
        yield part
    if not fresh and not inflate.eof:
        raise ValueError("the gzip stream ends early")


def members(parts: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """Each record of an inflated stream as the pieces of one gzip member; take all pieces before the next record."""
    held, at = b"", 0

    def fill(n: int) -> bool:
        nonlocal held, at
        while len(held) - at < n:
            part = next(parts, None)
            if part is None:
                return False
            held, at = held[at:] + part, 0
        return True

    def one(left: int) -> Iterator[bytes]:
        nonlocal at
        deflate = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, _GZIP)
        while left:
            if not fill(1):
                raise ValueError("the stream ends inside a record")
            part = held[at: at + left]
            at += len(part)
            left -= len(part)
            yield deflate.compress(part)
        yield deflate.flush()

    while fill(1):
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if len(held) - at > HEADER_BYTES or not fill(len(held) - at + 1):
                raise ValueError("no end of a record's headers")
        head = held[at:end]
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        if not head.startswith(b"WARC/") or not length:
            raise ValueError("no WARC record")
        yield one(len(head) + 4 + int(length[1]) + 4)


def read_back(index: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to) from the members that an index names.

    A response's size and digest are those of the payload read; a digest that its header does not confirm raises an
    error. A revisit has those its headers tell of the payload it stands for.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    store, path = located(archive)
                    name, file = archive, store.open_input_file(path)
                file.seek(offset)
                rows.append(parsed(zlib.decompress(file.read(length), _GZIP)))
            yield pa.RecordBatch.from_pylist(rows, _READ)

    return index.select("archive", "offset", "length").mapInArrow(
        read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    )


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def parsed(data: bytes) -> dict:
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one written")
    size = len(payload) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", http)[1])
    url = fields.get("WARC-Target-URI")
    number = {n: int(fields[n]) if n in fields else None for n in ("Page-Number", "Refers-To-Page")}
    return {
        "page_id": number["Page-Number"], "record_type": kind, "payload_bytes": size, "payload_digest": digest,
        "url": None if url is None else _PERCENT.sub(lambda c: chr(int(c[1], 16)), url), "refers_to": number["Refers-To-Page"],
    }


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a record per page, normalise the archives and read them back; see `decided` for who is a revisit.

    All files lie in one new folder below `spark.checkpoint.dir`. An empty table gives no archive and no row.
    """
    folder = new_path(pages.sparkSession, "warc")
    written = write_archives(decided(pages, key, url, payload), f"{folder}/streams")
    return read_back(normalise(written, f"{folder}/members"))
