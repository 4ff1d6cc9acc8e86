"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


#: Rows that go to a Python worker at once: whole texts are long, and batches of Spark's default size take memory twice
#: in the JVM and once in the worker.
BATCH_ROWS = 2000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Set up a session for these operators: rows a batch, where the session has not chosen its own, and the import path.

    Python workers import this package from where the driver has it. On a cluster whose machines have it elsewhere, ship
    it in the usual way (--py-files); an own PYTHONPATH of the session stays.
    """
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, BATCH_ROWS)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where it is unset, a temporary one, on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="reviewmill-llm-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Schemes that Hadoop has under another name than Arrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
DBFS_MOUNT = "/dbfs"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a file that Spark names, and the path in it, for files that workers read or write themselves.

    Buckets, HDFS and local folders are found; a scheme that Hadoop knows by another name is translated, and DBFS is read
    where every worker mounts it. Credentials are those that the workers' environment has.
    """
    scheme, mark, rest = uri.partition(":")
    if not mark or len(scheme) == 1:
        return fs.FileSystem.from_uri(uri)
    if scheme == "dbfs":
        return fs.LocalFileSystem(), f"{DBFS_MOUNT}/{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows of `frame`, written once and read again: lineage ends here and survives lost executors."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Delete a table made by `stored` that no later step reads."""
    spark = frame.sparkSession
    for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
