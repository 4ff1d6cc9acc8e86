"""Report sections in Markdown, and ticket payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill import constants as C
from reviewmill.functions import labels as L
from reviewmill.functions import text as X
from reviewmill.operators.views import flatten_issues


def _thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def kpi_block(kpis: DataFrame, analysed_at: str) -> DataFrame:
    """One row: the Markdown block of key figures from (metric, value) rows."""
    wide = kpis.groupBy().pivot(
        "metric",
        ["input_count", "normal_count", "spam_count", "spam_ratio", "encoding_repaired", "k",
         "sample_silhouette", "negative_count", "total_cost_usd"],
    ).agg(F.first("value"))

    def row(name: str, *value: Column) -> Column:
        return F.concat(F.lit(f"| {name} | "), *value, F.lit(" |"))

    unit = F.lit("건")
    lines = [
        F.lit(C.KPI_HEADING), F.lit(""), F.lit("| 지표 | 값 |"), F.lit("|---|---|"),
        row("분석 일시", F.lit(analysed_at)),
        row("입력 리뷰", _thousands(F.col("input_count")), unit),
        row("정상 리뷰", _thousands(F.col("normal_count")), unit),
        row("스팸 후보", _thousands(F.col("spam_count")), unit,
            F.format_string(" (%.1f%%)", F.col("spam_ratio") * 100)),
        row("인코딩 복구", _thousands(F.col("encoding_repaired")), unit),
        row("클러스터 수", F.col("k").cast("int").cast("string"),
            F.format_string(" (silhouette=%.3f)", "sample_silhouette")),
        row("부정 리뷰", _thousands(F.col("negative_count")), unit),
        row("LLM 비용", F.format_string("$%.4f", "total_cost_usd")),
        F.lit(""),
    ]
    return wide.select(F.concat_ws("\n", *lines).alias("markdown"))


def issue_table(negatives: DataFrame) -> DataFrame:
    """cluster_id, issue_no, line: one Markdown table row per issue."""
    ids = F.array_join(
        F.slice(F.col("representative_quotes.review_id"), 1, C.TABLE_QUOTE_IDS)
        .cast("array<string>"), ", ",
    )
    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ", F.col("issue_no").cast("string"), "severity",
            F.col("frequency").cast("string"), X.table_cell(F.col("title")),
            X.table_cell(F.col("title_en")), F.coalesce(ids, F.lit("")),
        ),
        F.lit(" |"),
    )
    return flatten_issues(negatives).select("cluster_id", "issue_no", line.alias("line"))


def topic_sections(topics: DataFrame, negatives: DataFrame) -> DataFrame:
    """cluster_id, size, markdown: one section per topic."""
    tables = (
        issue_table(negatives)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("issue_no", "line"))).alias("_rows"))
        .select(
            "cluster_id",
            F.concat(
                F.lit(f"\n{C.ISSUES_HEADING}\n\n{C.ISSUE_TABLE_HEADER}"),
                F.array_join(F.col("_rows.line"), "\n"), F.lit("\n"),
            ).alias("_issues"),
        )
    )

    def bullets(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat(F.lit("- "), s)), "\n")

    def words(column: str) -> Column:
        return F.coalesce(F.array_join(column, " · "), F.lit(""))

    quotes = F.array_join(
        F.transform(
            F.slice("representative_quotes", 1, C.REPORT_QUOTES),
            lambda q: F.concat(
                F.lit("> "), X.clip(q.text, C.REPORT_QUOTE_CHARS), F.lit(" _— review #"),
                q.review_id.cast("string"), F.lit("_\n\n"),
            ),
        ),
        "",
    )
    markdown = F.concat(
        F.lit("---\n\n### 클러스터 "), F.col("cluster_id").cast("string"), F.lit(" — "),
        F.coalesce("topic", F.lit("?")), F.lit(" ("), F.coalesce("topic_en", F.lit("?")),
        F.lit(")\n**리뷰 수**: "), _thousands(F.col("size")), F.lit(" / **감정**: "),
        L.sentiment_badge(F.col("sentiment")),
        F.lit("\n**키워드**: "), words("keywords_ko"),
        F.lit("\n**Keywords**: "), words("keywords_en"),
        F.lit("\n\n**요약**\n"), F.coalesce(bullets("summary"), F.lit("")),
        F.lit("\n\n**Summary**\n"), F.coalesce(bullets("summary_en"), F.lit("")),
        F.lit("\n\n**대표 인용**\n\n"), F.coalesce(quotes, F.lit("")),
        F.coalesce("_issues", F.lit("")), F.lit("\n"),
    )
    return topics.join(tables, "cluster_id", "left").select(
        "cluster_id", "size", markdown.alias("markdown")
    )


def report_sections(
    topics: DataFrame, negatives: DataFrame, kpis: DataFrame, title: str = C.REPORT_TITLE
) -> DataFrame:
    """section_no, markdown: title, key figures, heading, then topics by size, largest first.

    kpis is the one-row block from kpi_block. The numbering window spans the topics only.
    """
    head = kpis.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("section_no"), F.lit(f"{title}\n").alias("markdown")),
                F.struct(F.lit(2).alias("section_no"), F.col("markdown")),
                F.struct(F.lit(3).alias("section_no"),
                         F.lit(f"\n{C.TOPICS_HEADING}\n").alias("markdown")),
            )
        ).alias("s")
    ).select("s.section_no", "s.markdown")
    by_size = Window.orderBy(F.desc("size"), "cluster_id")
    body = topic_sections(topics, negatives).select(
        (F.row_number().over(by_size) + 3).alias("section_no"), "markdown"
    )
    return head.unionByName(body)


def ticket_rows(
    topics: DataFrame, negatives: DataFrame, project: str = C.TICKET_PROJECT
) -> DataFrame:
    """One ticket per issue of every cluster, as flat columns."""
    names = topics.select(
        "cluster_id", F.col("topic").alias("_topic"), F.col("topic_en").alias("_topic_en")
    )
    quotes = F.array_join(
        F.transform(
            F.slice("representative_quotes", 1, C.TICKET_QUOTES),
            lambda q: F.concat(
                F.lit('- "'), X.clip(q.text, C.TICKET_QUOTE_CHARS, ellipsis=False),
                F.lit('" (review #'), q.review_id.cast("string"), F.lit(")"),
            ),
        ),
        "\n",
    )
    quote_text = F.when(
        F.size(F.coalesce("representative_quotes", F.array())) > 0,
        F.concat(F.lit("\n\n대표 인용:\n"), quotes),
    ).otherwise("")
    cid = F.col("cluster_id").cast("string")
    description = F.concat(
        F.lit("클러스터: "), F.coalesce("_topic", F.concat(F.lit(C.FAILED_TOPIC_EN), cid)),
        F.lit(" ("), F.coalesce("_topic_en", F.lit("")), F.lit(")\n클러스터 부정 리뷰: "),
        F.coalesce("negative_review_count", F.lit(0)).cast("string"),
        F.lit("건\n이 이슈 추정 빈도: "), F.col("frequency").cast("string"),
        F.lit("건\n\n"), F.col("description"), F.lit("\n\n--- English ---\n"),
        F.col("description_en"), quote_text,
    )
    return (
        flatten_issues(negatives)
        .join(names, "cluster_id", "left")
        .select(
            "cluster_id",
            "issue_no",
            F.lit(project).alias("project"),
            F.lit(C.TICKET_ISSUE_TYPE).alias("issue_type"),
            F.concat(F.lit(C.TICKET_SUMMARY_PREFIX), F.col("title")).alias("summary"),
            description.alias("description"),
            L.priority(F.col("severity")).alias("priority"),
            F.concat(
                F.array(*[F.lit(x) for x in C.TICKET_LABELS]),
                F.array(F.concat(F.lit("cluster-"), cid),
                        F.concat(F.lit("severity-"), F.col("severity"))),
            ).alias("labels"),
        )
    )


def ticket_fields(tickets: DataFrame) -> DataFrame:
    """The nested form that a bulk-create request expects, one ticket per row."""
    return tickets.select(
        "cluster_id",
        "issue_no",
        F.struct(
            F.struct(F.col("project").alias("key")).alias("project"),
            F.struct(F.col("issue_type").alias("name")).alias("issuetype"),
            "summary",
            "description",
            F.struct(F.col("priority").alias("name")).alias("priority"),
            "labels",
        ).alias("fields"),
    )


def ticket_payload(tickets: DataFrame, most: int = C.TICKETS_A_REQUEST) -> DataFrame:
    """payload, part (from 0): the bulk-create requests as JSON, at most `most` tickets each, by cluster and issue number.
    Without tickets one empty request.

    A ticket's place is its number in its cluster after all tickets of the clusters before; only the clusters' sizes pass
    through one task.
    """
    numbered = ticket_fields(tickets).withColumn(
        "_place", F.row_number().over(Window.partitionBy("cluster_id").orderBy("issue_no")) - 1)
    sizes = numbered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "cluster_id",
        (F.sum("_n").over(Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    part = F.floor((F.col("_place") + F.col("_before")) / most)
    parts = numbered.join(before, "cluster_id").groupBy(part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("cluster_id", "issue_no", "fields"))).alias("_tickets"))
    wrapped = F.transform("_tickets", lambda t: F.struct(t.fields.alias("fields")))
    first = tickets.sparkSession.range(1).select(F.col("id").alias("part"))
    return parts.join(first, "part", "full").select(
        F.when(F.col("_tickets").isNull(), F.lit('{"issueUpdates":[]}'))
        .otherwise(F.to_json(F.struct(wrapped.alias("issueUpdates")))).alias("payload"),
        "part",
    )
