"""Text queries move no text, whatever Spark may broadcast."""

import re

import pytest

from reviewmill.plans.queries import QUERIES
from tests.plans import plan_of

TEXT_QUERIES = [
    "clean_text_score", "mojibake_repair", "blank_filter", "clean_stats", "lang_distribution",
    "url_marker", "clip_text", "inject_spam", "embed_text", "embed_usage",
]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_no_join_and_no_text_in_an_exchange(spark, folder, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, folder))
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan  # a price list may be looked up
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange" in line:
            below = next((x for x in lines[i + 1:] if re.search(r"Project|HashAggregate|Scan", x)), "")
            assert "text#" not in below, line


def test_scores_move_ids_and_a_boolean(spark, folder, no_broadcast):
    from reviewmill.operators import spam
    from reviewmill.plans.standin import Tables

    tables = Tables(spark, folder)
    plan = plan_of(spam.spam_scores(tables.texts, tables.vectors, tables.prototypes))
    marked = next(x for x in plan.splitlines() if "has_url" in x and "Project" in x and "RLIKE" in x.upper())
    assert "SortMergeJoin" in plan and "text" not in marked.split("RLIKE")[0].split("rlike")[0].split("[", 1)[1].split(",")[0]
