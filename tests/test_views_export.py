import json

import pytest

from reviewmill.operators import export, views
from reviewmill.schema import NEGATIVE, TOPIC


@pytest.fixture(scope="module")
def topics(spark):
    quote = [(5, " long\n" + "y" * 300), (6, "b"), (7, "c"), (8, "d")]
    return spark.createDataFrame(
        [(0, 1200, "가|나", "A", ["요약"], ["sum"], "positive", ["ㄱ"], ["k", "w"], quote),
         (1, 30, "나", "B", [], [], "odd", [], [], []),
         (-1, 30, "기타", "C", None, None, None, None, None, None)], TOPIC)


@pytest.fixture(scope="module")
def negatives(spark):
    quotes = [(5, "q" * 400), (6, "two"), (7, "three"), (8, "four")]
    issues = [("t|1", "e|1", "d", "de", "minor", 9, quotes),
              ("t2", "e2", "d2", "de2", "critical", 2, []),
              ("t3", "e3", "", "", "blocker", 50, [])]
    return spark.createDataFrame(
        [(0, "가|나", "A", 12, issues), (1, "나", "B", 0, []),
         (9, "lost", "L", 3, [("x", "y", "", "", "major", 1, [])])], NEGATIVE)


def test_topic_section_text(topics, negatives):
    text = {r["cluster_id"]: r["markdown"]
            for r in export.topic_sections(topics, negatives).collect()}
    clipped = ("long " + "y" * 300)[:200] + "…"
    assert text[0] == (
        "---\n\n### 클러스터 0 — 가|나 (A)\n**리뷰 수**: 1,200 / **감정**: 🟢 긍정\n"
        "**키워드**: ㄱ\n**Keywords**: k · w\n\n**요약**\n- 요약\n\n**Summary**\n- sum\n\n"
        f"**대표 인용**\n\n> {clipped} _— review #5_\n\n> b _— review #6_\n\n> c _— review #7_\n\n"
        "\n#### 🚨 주요 불만 이유\n\n"
        "| # | 심각도 | 빈도 | 이슈 (KO) | 이슈 (EN) | 대표 리뷰 |\n|---|---|---|---|---|---|\n"
        "| 1 | minor | 9 | t/1 | e/1 | 5, 6 |\n| 2 | critical | 2 | t2 | e2 |  |\n"
        "| 3 | blocker | 50 | t3 | e3 |  |\n\n")
    assert text[1].startswith("---\n\n### 클러스터 1 — 나 (B)\n**리뷰 수**: 30 / **감정**: \n")
    assert "🚨" not in text[1]
    assert "**감정**: 🟡 혼합" in text[-1]


def test_report_order(spark, topics, negatives):
    kpis = spark.createDataFrame(
        [("input_count", 5000.0), ("normal_count", 4781.0), ("spam_count", 201.0),
         ("spam_ratio", 201 / 4982), ("encoding_repaired", 60.0), ("k", 10.0),
         ("sample_silhouette", 0.1031), ("negative_count", 186.0), ("total_cost_usd", 0.010778)],
        "metric string, value double")
    block = export.kpi_block(kpis, "2026-01-02 03:04 UTC")
    sections = export.report_sections(topics, negatives, block).orderBy("section_no").collect()
    assert [s["section_no"] for s in sections] == [1, 2, 3, 4, 5, 6]
    assert sections[0]["markdown"].endswith("리포트\n")
    assert sections[1]["markdown"] == (
        "## 📊 KPI 요약\n\n| 지표 | 값 |\n|---|---|\n| 분석 일시 | 2026-01-02 03:04 UTC |\n"
        "| 입력 리뷰 | 5,000건 |\n| 정상 리뷰 | 4,781건 |\n| 스팸 후보 | 201건 (4.0%) |\n"
        "| 인코딩 복구 | 60건 |\n| 클러스터 수 | 10 (silhouette=0.103) |\n| 부정 리뷰 | 186건 |\n"
        "| LLM 비용 | $0.0108 |\n")
    heads = [s["markdown"].split("\n")[2] for s in sections[3:]]
    assert [h.split()[2] for h in heads] == ["0", "-1", "1"]


def test_tickets(topics, negatives):
    rows = export.ticket_rows(topics, negatives).orderBy("cluster_id", "issue_no").collect()
    assert [(r["cluster_id"], r["priority"]) for r in rows] == [
        (0, "Medium"), (0, "Highest"), (0, "Medium"), (9, "High")]
    assert rows[0]["summary"] == "[CX/리뷰분석] t|1"
    assert rows[0]["labels"] == ["cx-review", "auto-extracted", "cluster-0", "severity-minor"]
    assert rows[0]["description"] == (
        "클러스터: 가|나 (A)\n클러스터 부정 리뷰: 12건\n이 이슈 추정 빈도: 9건\n\nd\n\n"
        "--- English ---\nde\n\n대표 인용:\n"
        f"- \"{'q' * 300}\" (review #5)\n- \"two\" (review #6)\n- \"three\" (review #7)")
    assert rows[1]["description"].endswith("--- English ---\nde2")
    assert rows[3]["description"].startswith("클러스터: Cluster 9 ()\n")


def test_ticket_payload_is_one_request(topics, negatives):
    tickets = export.ticket_rows(topics, negatives, "ABC")
    payload = json.loads(export.ticket_payload(tickets).first()[0])
    assert [t["fields"]["summary"][-2:] for t in payload["issueUpdates"]] == ["|1", "t2", "t3", " x"]
    assert payload["issueUpdates"][0]["fields"]["project"] == {"key": "ABC"}
    assert set(payload["issueUpdates"][0]["fields"]) == {
        "project", "issuetype", "summary", "description", "priority", "labels"}
    assert json.loads(export.ticket_payload(tickets.limit(0)).first()[0]) == {"issueUpdates": []}
    parts = export.ticket_payload(tickets, most=3).orderBy("part").collect()
    held = [json.loads(p["payload"])["issueUpdates"] for p in parts]
    assert [p["part"] for p in parts] == [0, 1] and [len(h) for h in held] == [3, 1]
    assert held[0] + held[1] == payload["issueUpdates"]


def test_issue_ranking(negatives):
    rows = views.issue_ranking(negatives).collect()
    assert [(r["severity"], r["severity_rank"]) for r in rows] == [
        ("critical", 0), ("major", 1), ("minor", 2), ("blocker", 9)]
    assert rows[0]["severity_label"] == "🔴 Critical" and rows[3]["severity_label"] == "blocker"
    assert views.total_issues(negatives).first()[0] == 4
    assert views.total_issues(negatives.limit(0)).first()[0] == 0


def test_topic_ranking(spark, topics):
    counts = spark.createDataFrame(
        [(0, 12), (1, 15)], "cluster_id int, negative_review_count bigint")
    by_ratio = views.topic_ranking(topics, counts, "negative_ratio",
                                   ["positive", "mixed", "odd"]).collect()
    assert [(r["cluster_id"], r["negative_ratio"]) for r in by_ratio] == [
        (1, 0.5), (0, 0.01), (-1, 0.0)]
    assert [r["icon"] for r in by_ratio] == ["⚪", "🟢", "🟡"]
    by_size = views.topic_ranking(topics, counts).collect()
    assert [r["cluster_id"] for r in by_size] == [0, -1]
    with pytest.raises(ValueError):
        views.topic_ranking(topics, counts, "name")


def test_explorer(spark):
    rows = spark.createDataFrame(
        [(1, "A (b)", "en", True, 1.5, 0), (2, "a (B) c", "ko", False, 2.0, 1),
         (3, "z", "en", None, None, None)],
        "review_id bigint, text string, lang string, recommended boolean, playtime_hours double, "
        "cluster_id int")

    def ids(**kw):
        return [r["review_id"] for r in views.explorer_filter(rows, **kw).orderBy("review_id").collect()]

    assert ids() == [1, 2, 3]
    assert ids(search="(b") == [1, 2]
    assert ids(search="  ") == [1, 2, 3]
    assert ids(recommended=True) == [1] and ids(recommended=False) == [2]
    assert ids(playtime=(1.5, 2.0)) == [1, 2] and ids(playtime=(0.0, 1.9)) == [1]
    assert ids(clusters=[0, 1], langs=["ko"]) == [2]


def test_explorer_filters_reach_the_scan(spark, folder):
    from tests.plans import plan_of

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = plan_of(views.explorer_filter(docs, langs=["en", "fr"]).select("doc_id"))
    assert "PushedFilters: [In(lang, [en,fr])]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
