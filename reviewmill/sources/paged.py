"""Rows stored in the order of the explorer's pages, so that a page opens one file or two, however deep it lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reviewmill import constants as C
from reviewmill.operators.scale import delete_path, materialize

#: Rows of a file, and bytes of their values; whichever gives more files.
ROWS_A_FILE, BYTES_A_FILE = 1_000_000, 128 << 20


def page_order(columns: list[str]) -> list[Column]:
    """By review_id, NULL last; equal ids by a hash of the row, then by its values."""
    return [F.col("review_id").asc_nulls_last(), F.xxhash64(*[F.col(c) for c in columns]).asc(), *[F.col(c).asc() for c in columns]]


def write_pages(df: DataFrame, path: str, rows_a_file: int = ROWS_A_FILE, largest_page: int = C.PAGE_SIZE,
                bytes_a_file: int = BYTES_A_FILE) -> None:
    """Store the rows in files that follow one another in the order of pages, and a sparse index: of each file its place, its
    first id, its number of rows and the number of rows before it. A file is what a task sorts and writes, so the more bytes
    the rows have, the more files there are.

    Where the order is cut is estimated from a sample, so files differ in size; should one but the last hold fewer rows than
    `largest_page`, fewer files are written, as pages of that size are to lie in two files at most.
    """
    spark = df.sparkSession
    source = materialize(df)
    order = page_order(df.columns)
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0).cast("long"))
    rows, held = source.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    files = max(1, -(-rows // rows_a_file), -(-held // bytes_a_file))
    while True:
        delete_path(spark, f"{path}/rows")
        source.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
        index = _index(spark, path)
        small = index.where(F.col("next").isNotNull() & (F.col("rows") < largest_page)).limit(1).count()
        if not small or files == 1:
            break
        files //= 2
    index.drop("next").write.mode("overwrite").parquet(f"{path}/index")


def _index(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(f"{path}/rows")
    per_file = stored.select(F.col("_metadata.file_path").alias("file"), "review_id").groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.min("review_id").alias("first_id"))
    # a row a file; their names tell their order, as every range is written under its number
    order = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint"))
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialize(per_file.select(
        "file", "first_id", "rows", before.alias("before"), F.lead("file").over(order).alias("next")))


def read_page(spark: SparkSession, path: str, number: int, size: int = C.PAGE_SIZE) -> DataFrame:
    """The given page (from 1); no rows past the end."""
    start = (number - 1) * size
    index = spark.read.parquet(f"{path}/index")
    touched = index.where((F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)).collect()
    everything = spark.read.parquet(f"{path}/rows")
    if not touched:
        return everything.limit(0)
    rows = spark.read.schema(everything.schema).parquet(*[r["file"] for r in touched])
    skip = start - min(r["before"] for r in touched)
    return rows.orderBy(*page_order(rows.columns)).offset(skip).limit(size)
