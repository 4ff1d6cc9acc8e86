import pytest

from checks.compare import duck, duck_rows, normal_form, spark_rows
from reviewmill.llm.oracle import ORACLE
from reviewmill.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_in_duckdb(spark, folder, name):
    columns, rows = spark_rows(QUERIES[name](spark, folder))
    expected_columns, expected = duck_rows(duck(folder), ORACLE[name])
    assert sorted(columns) == sorted(expected_columns)
    assert normal_form(columns, rows) == normal_form(expected_columns, expected)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
