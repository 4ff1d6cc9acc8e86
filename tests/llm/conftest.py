import pytest

LONG = " ".join(f"wort{i % 977} lang{i % 31}" for i in range(60_000))
COLUMNS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, key string, print string, size string, "
           "`row` string, target string, block string")


def hard_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns named like those of the operators."""
    extra = ("k", None, "s", "r", "t", None)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 4), (4, "one", "en", "b", 3),
        (5, "one two three", "en", None, 13), (6, LONG, "de", "b", len(LONG)), (7, LONG + " end", "de", "c", len(LONG) + 4),
        (8, "12345 !!! ...", None, "a", 13), (9, "Same text here twice, word for word", "en", "a", 35),
        (9, "Same text here twice, word for word", "en", "a", 35), (10, "Same text here twice, word for word", "fr", "b", 35),
        (None, "Without a number", "en", "a", 16), (None, None, None, None, None), (11, "é ß Σ 日本語 🙂 \x1c", "fr", "c", 12),
    ]
    return [r + extra for r in rows]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
