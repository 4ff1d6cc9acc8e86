import gzip
import hashlib
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import warc
from reviewmill.llm.scratch import new_path


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_hard_rows(spark, nothing):
    big = "<p>" + "long text " * 300_000
    same = "x" * 100
    rows = [(5, "http://a/ b\r\nWARC-Type: evil", same), (3, None, same), (9, "u", same), (None, "n", same), (1, "u", "y" * 99),
            (2, "u", "y" * 99), (4, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (3, "twice", same), (10, "é%0A日", "é" * 50),
            (11, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n12345\r\n\r\n" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).repartition(3)
    got = {}
    for r in warc.archived(pages).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for key, url, page in rows:
        data = (page or "").encode()
        match = [r for r in got[key] if r.url == url]
        assert len(match) == 1 and (match[0].payload_bytes, match[0].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    revisits = {k: {r.refers_to for r in v} for k, v in got.items() if v[0].record_type == "revisit"}
    assert revisits == {5: {3}, 9: {3}, None: {3}, 8: {7}}
    assert all(r.refers_to is None for v in got.values() for r in v if r.record_type == "response")
    empty = nothing.select(F.col("doc_id").alias("page_id"), F.col("key").alias("url"), F.col("text").alias("html"))
    assert warc.archived(empty).count() == 0


def test_index_leads_to_members(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    base = new_path(spark, "test-warc")
    written = warc.write_archives(warc.decided(pages), f"{base}/streams", size=50_000)
    assert written.count() > 3
    index = warc.normalise(written, f"{base}/members")
    archives = index.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members")).collect()
    assert len(archives) == written.count()
    records = 0
    for row in archives:
        path = row.archive.removeprefix("file://")
        with open(path, "rb") as file:
            data = file.read()
        with open(f"{path}.idx") as file:
            assert [tuple(map(int, line.split())) for line in file] == [tuple(m) for m in row.members]
        at = 0
        for offset, length in row.members:
            assert offset == at
            member = gzip.decompress(data[offset: offset + length])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
            at += length
            records += 1
        assert at == len(data)
    assert records == pages.count() == warc.read_back(index).count()


def record(key, text):
    return warc.record({"page_id": key, "url": "u", "payload": text, "digest": hashlib.sha256(text.encode()).hexdigest(), "refers_to": None})


def split(data, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    source = pa.BufferReader(data)
    return [warc.parsed(gzip.decompress(b"".join(m))) for m in warc.members(warc._inflated(source))]


def test_any_layout_of_the_stream(monkeypatch):
    texts = ["", "a" * 5000, "b\r\n\r\nWARC/1.1", "c"]
    records = [record(i, t) for i, t in enumerate(texts)]
    whole = gzip.compress(b"".join(records))
    parts = b"".join(map(gzip.compress, records))
    odd = gzip.compress(records[0] + records[1][:100]) + gzip.compress(records[1][100:] + records[2]) + gzip.compress(b"") + gzip.compress(records[3])
    for data in (whole, parts, odd):
        for chunk in (7, 1000, 1 << 20):
            got = split(data, monkeypatch, chunk)
            assert [(r["page_id"], r["payload_bytes"]) for r in got] == [(i, len(t)) for i, t in enumerate(texts)]
    assert split(b"", monkeypatch, 100) == []
    with pytest.raises((ValueError, zlib.error, EOFError)):
        split(whole[:-20], monkeypatch, 100)
    with pytest.raises(ValueError):
        split(gzip.compress(b"".join(records)[:-30]), monkeypatch, 100)
    with pytest.raises(ValueError):
        split(gzip.compress(b"no archive\r\n\r\n"), monkeypatch, 100)


def test_a_wrong_digest_is_found():
    data = record(1, "text").replace(b"text\r\n\r\n", b"tent\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parsed(data)
