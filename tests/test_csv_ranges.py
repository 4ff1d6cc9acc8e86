"""CSV read in ranges gives the rows that reading each file whole gives."""

import csv
import io
import random

import pytest
from pyspark.sql import Observation

from reviewmill.sources import csv_ranges, reviews as R

HEADER = ["review_id", "text", "lang", "recommended", "playtime_hours", "posted_at"]


def whole(spark, path):
    frame = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return sorted(map(tuple, frame.collect()), key=repr)


def in_ranges(spark, path, split, columns=HEADER):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        frame = csv_ranges.read_csv(spark, path, columns)
        return sorted(map(tuple, frame.collect()), key=repr), csv_ranges._lines(spark, path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def made_up(chance, n, end):
    words = ["plain", 'say ""what""', "a, b", "two\nlines", "three\n\n\nlines, \"q\"", "좋은 게임", "", " spaced ", 'in"ch', "\u00e9\U0001f642"]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(HEADER)
    for i in range(n):
        text = " ".join(chance.choice(words) for _ in range(chance.randrange(0, 6)))
        writer.writerow([i, text, chance.choice(["en", "ko", ""]), chance.choice(["True", "False", ""]), chance.random(), "2024-01-01"])
        if i % 17 == 0:
            out.write(end)  # an empty line
        if i % 13 == 0:
            out.write(f'{i},6" screen,en,True,1.5,x"y"{end}')  # quotes inside plain values
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_rows_as_reading_the_file_whole(spark, tmp_path, end):
    content = made_up(random.Random(5), 400, end)
    file = tmp_path / "reviews.csv"
    file.write_bytes(content.encode())
    want = whole(spark, str(file))
    assert len(want) == 431
    for split in (300, 1000, 5000, 10**8):
        got, tasks = in_ranges(spark, str(file), split)
        assert got == want
        assert tasks > len(content.encode()) / split * 0.9
    without_end = tmp_path / "open.csv"
    without_end.write_bytes(content.encode().rstrip())
    assert in_ranges(spark, str(without_end), 700)[0] == whole(spark, str(without_end))


def test_a_record_longer_than_many_ranges(spark, tmp_path):
    file = tmp_path / "long.csv"
    text = "line, of \"\"text\"\"\n" * 400
    file.write_text(",".join(HEADER) + f'\n1,a,en,True,1,x\n2,"{text}",en,False,2,y\n3,"b\nc",ko,True,3,z\n')
    got, tasks = in_ranges(spark, str(file), 500)
    assert got == whole(spark, str(file)) and tasks > 10 and len(got) == 3


def test_folder_of_files_and_files_without_rows(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(made_up(random.Random(i), 40, "\n"))
    (tmp_path / "none.csv").write_text(",".join(HEADER) + "\n")
    assert in_ranges(spark, str(tmp_path), 400)[0] == whole(spark, str(tmp_path))


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('"a,b', True, False), ('a"b,c', False, False), ('a,"b"', False, False), ('"a""b', True, False),
    ('x",y', False, False), ('x","y', True, True), ('"","', True, False), ("", False, True), ('""', False, True),
    ('"a"b,"c', True, True), (',,"', True, False),
])
def test_what_a_line_does(line, outside, inside):
    assert csv_ranges.after(line, False) is outside
    assert csv_ranges.after(line, True) is inside


def test_bad_values_are_counted_while_rows_are_read(spark, tmp_path):
    file = tmp_path / "bad.csv"
    file.write_text(",".join(HEADER) + '\n1,"a\nb",en,True,x,d\noops,b,en,maybe,1.5,d\n3,c,en,,,\n')
    seen = Observation("bad values")
    assert R.read_reviews_csv(spark, str(file), seen).count() >= 0
    rows = R.read_reviews_csv(spark, str(file), again := Observation("again")).collect()
    assert len(rows) == 3 and again.get == R.unparsable(spark, str(file)).first().asDict()
    assert again.get["review_id"] == 1 and again.get["recommended"] == 1 and again.get["playtime_hours"] == 1
