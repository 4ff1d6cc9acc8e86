import random

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import views
from reviewmill.sources import paged, text_index

WORDS = ["crash", "게임이", "재미있다", "story", "Größe", "boss fight", "save file", "İstanbul", "noun"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Twelve files of texts, each from words of its own besides common ones."""
    chance = random.Random(3)
    rows = []
    for i in range(600):
        own = [f"only{i // 50}x", WORDS[(i // 50) % len(WORDS)]]
        rows.append((i, i // 50, None if i % 41 == 0 else " ".join(chance.choices(["good", "bad", *own], k=8))))
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(rows, "review_id bigint, part int, text string").repartitionByRange(12, "part").write.parquet(f"{path}/rows")
    text_index.write_text_index(spark, f"{path}/rows", f"{path}/index")
    return f"{path}/rows", f"{path}/index"


@pytest.mark.parametrize("wanted, most", [
    ("only7x", 1), ("ONLY11X", 1), ("재미있다", 2), ("게임이 ", 2), ("größe", 2), ("good", 12), ("nowhere to be found", 0),
    ("ab", 12), ("x", 12), ("save file good", 2),
])
def test_same_rows_from_fewer_files(spark, table, wanted, most):
    rows, index = table
    got = sorted(tuple(r) for r in text_index.search_text(spark, rows, index, wanted).collect())
    plain = views.explorer_filter(spark.read.parquet(rows), search=wanted)
    assert got == sorted(tuple(r) for r in plain.collect())
    files = text_index.matching_files(spark, rows, index, wanted)
    assert len(files) <= most and len(spark.read.parquet(rows).inputFiles()) == 12


def test_blank_search_and_files_that_came_later(spark, table, tmp_path):
    rows, index = table
    assert text_index.search_text(spark, rows, index, "  ").count() == 600
    grown = str(tmp_path / "grown")
    spark.read.parquet(rows).write.parquet(grown)
    text_index.write_text_index(spark, grown, str(tmp_path / "index"))
    spark.createDataFrame([(999, 9, "late only7x")], "review_id bigint, part int, text string").write.mode("append").parquet(grown)
    found = text_index.search_text(spark, grown, str(tmp_path / "index"), "late only7X").collect()
    assert [r["review_id"] for r in found] == [999]


def test_pages_of_a_stored_table(spark, tmp_path):
    rows = [(i // 3 * 7 if i % 11 else None, f"t{i % 5}") for i in range(1000)]
    df = spark.createDataFrame(rows, "review_id bigint, text string").repartition(4)
    path = str(tmp_path / "pages")
    paged.write_pages(df, path, rows_a_file=150, largest_page=60)
    files = spark.read.parquet(f"{path}/rows").inputFiles()
    assert 4 <= len(files) <= 7
    for number in (1, 2, 5, 9, 15, 16, 17, 18):
        page = paged.read_page(spark, path, number, 60)
        assert page.collect() == views.page(df, number, 60).collect()
        assert len(page.inputFiles()) <= 2 or number > 17


def test_a_third_of_all_rows_under_one_id(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("review_id"), F.col("id").alias("text"))
    path = str(tmp_path / "pages")
    paged.write_pages(df, path, rows_a_file=200, largest_page=50)
    for number in (1, 2, 13, 21, 60):
        page = paged.read_page(spark, path, number, 50)
        assert page.collect() == views.page(df, number, 50).collect() and len(page.inputFiles()) <= 2
    paged.write_pages(df.limit(0), str(tmp_path / "none"))
    assert paged.read_page(spark, str(tmp_path / "none"), 1).collect() == []


def test_files_smaller_than_a_page_are_merged(spark, tmp_path):
    df = spark.range(90).withColumnRenamed("id", "review_id")
    path = str(tmp_path / "pages")
    paged.write_pages(df, path, rows_a_file=10, largest_page=25)
    sizes = [r["rows"] for r in spark.read.parquet(f"{path}/index").orderBy("before").collect()]
    assert sum(sizes) == 90 and min(sizes[:-1], default=25) >= 25


def test_long_rows_lie_in_more_files(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("review_id"), F.repeat(F.col("id").cast("string"), 2000).alias("text"))
    path = str(tmp_path / "pages")
    paged.write_pages(df, path, largest_page=20, bytes_a_file=500_000)
    sizes = [r["rows"] for r in spark.read.parquet(f"{path}/index").collect()]
    assert sum(sizes) == 400 and 3 <= len(sizes) <= 6 and max(sizes) < 250
    for number in (1, 7, 20):
        assert paged.read_page(spark, path, number, 20).collect() == views.page(df, number, 20).collect()
