import pytest
from pyarrow import fs

from reviewmill.llm import scratch


def test_local_files(tmp_path):
    (tmp_path / "a b").write_bytes(b"x")
    for uri in (str(tmp_path / "a b"), f"file://{tmp_path}/a%20b", f"file:{tmp_path}/a%20b"):
        store, path = scratch.located(uri)
        assert isinstance(store, fs.LocalFileSystem) and store.open_input_file(path).read() == b"x"


def test_names_that_hadoop_has_for_stores(monkeypatch, tmp_path):
    asked = []

    class Asked:
        LocalFileSystem = fs.LocalFileSystem

        class FileSystem:
            @staticmethod
            def from_uri(uri):
                asked.append(uri)
                return None, uri

    monkeypatch.setattr(scratch, "fs", Asked)
    for uri in ("s3a://bucket/k", "s3://bucket/k", "s3n://bucket/k", "hdfs://host:8020/k", "gs://bucket/k", "wasbs://c@a/k"):
        scratch.located(uri)
    assert asked == ["s3://bucket/k", "s3://bucket/k", "s3://bucket/k", "hdfs://host:8020/k", "gs://bucket/k", "abfss://c@a/k"]
    monkeypatch.setattr(scratch, "DBFS_MOUNT", str(tmp_path))
    (tmp_path / "in").write_bytes(b"y")
    for uri in ("dbfs:/in", "dbfs:///in"):
        store, path = scratch.located(uri)
        assert store.open_input_file(path).read() == b"y"


def test_an_unknown_store_is_named():
    with pytest.raises(Exception, match="nowhere"):
        scratch.located("nowhere://x/y")
