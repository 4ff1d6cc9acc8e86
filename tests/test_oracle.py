"""Every registered query agrees with its DuckDB counterpart on the smallest data folder."""

import pytest

from checks.compare import differences, duck
from checks.oracle import ORACLE
from reviewmill.plans.queries import QUERIES

ROWS_ONLY = {"pca_projection", "kmeans_assign", "select_k", "clustering_job", "whole_analysis", "replay",
             "variant_agreement"}  # hashed words: see test_variants.py


@pytest.fixture(scope="module")
def connection(folder):
    return duck(folder)


def test_only_iterative_queries_lack_a_counterpart():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, connection, folder):
    assert differences(name, spark, connection, folder) is None


def test_entry(spark):
    import __spark_entry__ as e

    frame = e.entry(spark)
    assert frame.columns == ["cluster_id", "size", "negative_review_count", "negative_ratio"]
    assert frame.count() > 0
