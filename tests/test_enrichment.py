import json

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import enrichment as E, ledger
from reviewmill.schema import TOPIC


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(
        [(1, "one\ntwo", "en", True), (2, "x" * 500, "ko", False), (3, "three", None, None)],
        "review_id bigint, text string, lang string, recommended boolean")


def test_topic_prompt_lines(spark, reviews):
    picks = spark.createDataFrame(
        [(7, 3, 1), (7, 2, 2), (7, 99, 3), (7, 1, 4)], "cluster_id int, review_id bigint, rank int")
    row = E.topic_prompts(picks, reviews, "END").first()
    lines = row["prompt"].split("\n")
    assert row["n_reviews"] == 3
    assert lines[:4] == ["# 클러스터 ID: 7", "# 리뷰 수: 3건 중 대표 3건", "", "## 리뷰 목록"]
    assert lines[4] == "- [id=3, ?, 👍추천] three"
    assert lines[5] == "- [id=2, ko, 👎비추천] " + "x" * 400 + "…"
    assert lines[6:] == ["- [id=1, en, 👍추천] one two", "", "END"]


def test_issue_prompt_lines(spark, reviews):
    sample = spark.createDataFrame([(7, 2, 1)], "cluster_id int, review_id bigint, rank int")
    topics = spark.createDataFrame([(7, "story")], "cluster_id int, topic string")
    lines = E.issue_prompts(sample, reviews, topics, "END").first()["prompt"].split("\n")
    assert lines == ["# 클러스터: story (id=7)", "# 부정 리뷰 1건 샘플", "", "## 부정 리뷰",
                     "- [id=2, ko] " + "x" * 350 + "…", "", "END"]


def test_call_model_retries_once_and_records_errors(spark):
    prompts = spark.createDataFrame(
        [(1, "good"), (2, "broken"), (3, "list"), (4, "flaky"), (5, "empty")],
        "cluster_id int, prompt string").coalesce(1)
    tries = {}

    def client(prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        if prompt == "broken":
            raise RuntimeError("no answer")
        if prompt == "flaky" and tries[prompt] == 1:
            return "{not json", 10, 1
        return {"list": "[1]", "empty": ""}.get(prompt, '{"a": 1}'), 10, 1

    rows = {r["cluster_id"]: r for r in E.call_model(prompts, client).collect()}
    assert rows[1]["response"] == '{"a": 1}' and rows[1]["error"] is None
    assert rows[2]["response"] is None and rows[2]["error"] == "no answer"
    assert rows[2]["tokens_in"] == 0
    assert rows[3]["error"] == "reply is not a JSON object" and rows[3]["tokens_in"] == 20
    assert rows[4]["response"] == '{"a": 1}' and rows[4]["tokens_in"] == 20
    assert rows[5]["response"] == "{}"
    used = E.usage(E.call_model(prompts, client), "naming", "gpt-4o-mini")
    assert used.count() == 4


def topics_from(spark, reviews, replies):
    calls = spark.createDataFrame(
        [(i, json.dumps(r) if isinstance(r, dict) else r, e) for i, r, e in replies],
        "cluster_id int, response string, error string")
    clusters = spark.createDataFrame(
        [(i, 10 + i, [3, 2, 1, 9]) for i, _, _ in replies],
        "cluster_id int, size bigint, representatives array<bigint>")
    return {r["cluster_id"]: r for r in E.parse_topics(calls, clusters, reviews).collect()}


def test_topic_records(spark, reviews):
    full = {"topic": "t", "topic_en": "e", "summary": ["s"], "summary_en": ["u"],
            "sentiment": "negative", "keywords_ko": ["k"], "keywords_en": ["w"],
            "representative_quote_ids": [2, "1", "x", None, 2, 77]}
    got = topics_from(spark, reviews, [
        (1, full, None), (2, {}, None), (3, {"topic": None, "representative_quote_ids": []}, None),
        (4, None, "boom"), (5, {"representative_quote_ids": ["x"]}, None), (6, "{bad", None)])
    assert [q["review_id"] for q in got[1]["representative_quotes"]] == [2, 1, 2]
    assert got[1]["representative_quotes"][1]["text"] == "one\ntwo"
    assert (got[1]["topic"], got[1]["sentiment"], got[1]["size"]) == ("t", "negative", 11)
    for i in (2, 3, 6):
        assert (got[i]["topic"], got[i]["topic_en"], got[i]["sentiment"]) == (
            "(미정)", "(unknown)", "mixed")
        assert [q["review_id"] for q in got[i]["representative_quotes"]] == [3, 2, 1]
    assert got[4]["topic"] == "클러스터 4" and got[4]["topic_en"] == "Cluster 4"
    assert got[4]["summary_en"] == ["LLM call failed: boom"]
    assert [q["review_id"] for q in got[4]["representative_quotes"]] == [3, 2, 1]
    assert got[5]["representative_quotes"] == []
    assert list(got[1].asDict()) == TOPIC.names


def test_issue_records(spark, reviews):
    replies = [
        (1, json.dumps({"issues": [
            {"title": "a|b", "severity": "critical", "frequency": 3,
             "representative_quote_ids": [2, 2, "z"]},
            {"title_en": "only", "frequency": None}, {"frequency": "4.8"}, {"frequency": "many"}, {"frequency": 1e12}, {"frequency": "NaN"},
        ]}), None),
        (2, '{"issues": []}', None), (3, "{}", None), (4, None, "boom"), (5, "{bad", None)]
    calls = spark.createDataFrame(replies, "cluster_id int, response string, error string")
    counts = spark.createDataFrame(
        [(i, 5 + i) for i in range(1, 6)], "cluster_id int, negative_review_count bigint")
    topics = spark.createDataFrame(
        [(i, f"t{i}", f"e{i}") for i in range(1, 7)],
        "cluster_id int, topic string, topic_en string")
    got = {r["cluster_id"]: r for r in E.negative_records(
        counts, topics, E.parse_issues(calls), reviews).collect()}
    first = got[1]["issues"]
    assert [i["frequency"] for i in first] == [3, 0, 4, 0, 0, 0]
    assert [i["severity"] for i in first] == ["critical"] + ["minor"] * 5
    assert [i["title"] for i in first] == ["a|b"] + ["(미정)"] * 5
    assert [q["review_id"] for q in first[0]["representative_quotes"]] == [2, 2]
    assert got[2]["issues"] == got[3]["issues"] == got[5]["issues"] == []
    assert got[4]["issues"][0]["title_en"] == "LLM failure"
    assert got[4]["issues"][0]["description"] == "boom"
    assert got[6]["negative_review_count"] == 0 and got[6]["issues"] == []


def test_ledger_sums(spark):
    calls = spark.createDataFrame(
        [(2, "b", "gpt-4o-mini", 1000, 500), (1, "b", "unlisted", 7, 7),
         (3, "a", "text-embedding-3-small", 237_542, 0)],
        "seq bigint, step string, model string, tokens_in bigint, tokens_out bigint")
    costs = ledger.call_cost(calls)
    by_seq = {r["seq"]: r["cost"] for r in costs.collect()}
    assert by_seq[1] == 0.0
    assert by_seq[2] == pytest.approx((1000 * 0.15 + 500 * 0.6) / 1e6)
    assert by_seq[3] == pytest.approx(0.00475084)
    steps = {r["step"]: r for r in ledger.cost_by_step(costs).collect()}
    assert (steps["b"]["calls"], steps["b"]["tokens_in"], steps["b"]["model"]) == (2, 1007, "unlisted")
    assert ledger.total_cost(costs).first()[0] == pytest.approx(0.005201)
    assert ledger.total_cost(costs.where(F.lit(False))).first()[0] == 0.0
