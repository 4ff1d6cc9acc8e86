"""Enrichment by an outside model: prompts as a column, a partition-wise call, strict parsing.

The model itself is a caller-supplied function; see call_model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill import constants as C
from reviewmill.functions import text as X
from reviewmill.functions.labels import recommend_flag
from reviewmill.operators.scale import pin
from reviewmill.schema import ISSUE_REPLY, TOPIC_REPLY

TOPIC_INSTRUCTIONS = (
    "\nYou read player reviews and name what they have in common. Cluster -1 holds reviews that fit no other "
    "cluster: say so in its name. "
    "Reply with one JSON object and nothing else. Keys: topic (Korean, at most 20 characters), "
    "topic_en (at most 6 words), summary and summary_en (three one-sentence lines each), "
    "sentiment (positive, negative or mixed), keywords_ko, keywords_en, "
    "representative_quote_ids (2 or 3 ids from the list above). "
    "Use only what the reviews state.\n"
)
ISSUE_INSTRUCTIONS = (
    "\nYou sort complaints of players for developers. "
    "Reply with one JSON object and nothing else: {\"issues\": [...]} with 1 to 5 complaints, "
    "most frequent first, or an empty list. Each has title (Korean, at most 30 characters), "
    "title_en, description, description_en (2 or 3 sentences, with steps to reproduce where "
    "given), severity (critical: blocks playing; major: spoils it; minor: a nuisance), frequency "
    "(number of reviews that mention it), representative_quote_ids (2 or 3 ids from above). "
    "Use only what the reviews state.\n"
)


def lookup_reviews(picks: DataFrame, reviews: DataFrame, *columns: str) -> DataFrame:
    """Picked ids with their review columns; ids without a review disappear."""
    return picks.join(reviews.select("review_id", *columns), "review_id")


def _prompt(lines: DataFrame, keys: list[str], heading: Column, instructions: str) -> DataFrame:
    """One prompt per key from (rank, line). Ranks are bounded, so the collected list is too."""
    return (
        lines.groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("_lines"),
            F.count(F.lit(1)).alias("n_reviews"),
        )
        .select(
            *keys,
            "n_reviews",
            F.concat_ws(
                "\n", heading, F.array_join(F.col("_lines.line"), "\n"), F.lit(""),
                F.lit(instructions),
            ).alias("prompt"),
        )
    )


def topic_prompts(
    picks: DataFrame, reviews: DataFrame, instructions: str = TOPIC_INSTRUCTIONS
) -> DataFrame:
    """cluster_id, n_reviews, prompt from picks (cluster_id, review_id, rank)."""
    found = lookup_reviews(picks, reviews, "text", "lang", "recommended")
    lines = found.select(
        "cluster_id",
        "rank",
        F.concat(
            F.lit("- [id="), F.col("review_id").cast("string"), F.lit(", "),
            F.coalesce("lang", F.lit("?")), F.lit(", "), recommend_flag(F.col("recommended")),
            F.lit("] "), X.clip(F.col("text"), C.TOPIC_PROMPT_CHARS),
        ).alias("line"),
    )
    count = F.col("n_reviews").cast("string")
    heading = F.concat(
        F.lit("# 클러스터 ID: "), F.col("cluster_id").cast("string"), F.lit("\n# 리뷰 수: "),
        count, F.lit("건 중 대표 "), F.least(F.col("n_reviews"), F.lit(10)).cast("string"),
        F.lit("건\n\n## 리뷰 목록"),
    )
    return _prompt(lines, ["cluster_id"], heading, instructions)


def issue_prompts(
    sample: DataFrame,
    reviews: DataFrame,
    topics: DataFrame,
    instructions: str = ISSUE_INSTRUCTIONS,
) -> DataFrame:
    """cluster_id, topic, n_reviews, prompt from a negative sample (cluster_id, review_id, rank)
    and topic names (cluster_id, topic)."""
    found = lookup_reviews(sample, reviews, "text", "lang")
    lines = found.select(
        "cluster_id",
        "rank",
        F.concat(
            F.lit("- [id="), F.col("review_id").cast("string"), F.lit(", "),
            F.coalesce("lang", F.lit("?")), F.lit("] "),
            X.clip(F.col("text"), C.ISSUE_PROMPT_CHARS),
        ).alias("line"),
    ).join(topics.select("cluster_id", "topic"), "cluster_id")
    heading = F.concat(
        F.lit("# 클러스터: "), F.col("topic"), F.lit(" (id="),
        F.col("cluster_id").cast("string"), F.lit(")\n# 부정 리뷰 "),
        F.col("n_reviews").cast("string"), F.lit("건 샘플\n\n## 부정 리뷰"),
    )
    return _prompt(lines, ["cluster_id", "topic"], heading, instructions)


def call_model(
    prompts: DataFrame, client_fn: Callable[[str], tuple[str, int, int]], retries: int = 1
) -> DataFrame:
    """Adds response, tokens_in, tokens_out, error by calling client_fn(prompt) in the executors.

    client_fn returns (reply, tokens_in, tokens_out). A reply must be a JSON object; anything else,
    and any exception, is tried again and then recorded in error. Each try that returned is paid
    for, so its tokens count.
    """
    import json

    def ask(prompt: str) -> tuple:
        used_in = used_out = 0
        problem = None
        for _ in range(retries + 1):
            try:
                reply, tokens_in, tokens_out = client_fn(prompt)
                used_in, used_out = used_in + tokens_in, used_out + tokens_out
                if not isinstance(json.loads(reply or "{}"), dict):
                    raise ValueError("reply is not a JSON object")
                return reply or "{}", used_in, used_out, None
            except Exception as exc:  # the error becomes data
                problem = str(exc) or type(exc).__name__
        return None, used_in, used_out, problem

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [ask(p) for p in batch["prompt"]]
            names = ["response", "tokens_in", "tokens_out", "error"]
            yield batch.join(pd.DataFrame(answers, columns=names, index=batch.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(
        run, f"{fields}, response string, tokens_in bigint, tokens_out bigint, error string"
    )


def usage(calls: DataFrame, step: str, model: str, key: str | None = None) -> DataFrame:
    """Ledger rows (step, model, tokens_in, tokens_out) of the calls that returned something; with a key column also call,
    by which the ledger knows a call it has."""
    named = [F.col(key).cast("string").alias("call")] if key else []
    return calls.where("tokens_in + tokens_out > 0").select(
        F.lit(step).alias("step"), F.lit(model).alias("model"), "tokens_in", "tokens_out", *named
    )


def resolve_quotes(wanted: DataFrame, keys: list[str], reviews: DataFrame) -> DataFrame:
    """keys, quotes: ids (text, in column quote_ids) looked up in the reviews, in order.

    Ids that are no integers or have no review are skipped; repeated ids stay repeated. Every key
    is kept, with an empty list where nothing was found.
    """
    ids = wanted.select(*keys, F.posexplode("quote_ids").alias("_pos", "_id")).select(
        *keys, "_pos", F.expr("try_cast(trim(_id) AS BIGINT)").alias("review_id")
    )
    found = (
        pin(ids)  # written once and of known size: few ids do not make Spark shuffle all texts
        .join(reviews.select("review_id", "text"), "review_id")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "review_id", "text"))).alias("_found"))
        .select(
            *keys,
            F.transform(
                "_found",
                lambda q: F.struct(q.review_id.alias("review_id"), q.text.alias("text")),
            ).alias("quotes"),
        )
    )
    empty = F.array().cast("array<struct<review_id:bigint,text:string>>")
    return wanted.select(*keys).join(found, keys, "left").withColumn(
        "quotes", F.coalesce("quotes", empty)
    )


def _texts(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def parse_topics(calls: DataFrame, clusters: DataFrame, reviews: DataFrame) -> DataFrame:
    """Topic records from replies.

    calls: cluster_id, response, error. clusters: cluster_id, size, representatives. A failed call
    gives a record that says so. Without quote ids the first three representatives are quoted.
    """
    reply = F.from_json("response", TOPIC_REPLY, {"mode": "PERMISSIVE"})
    cid = F.col("cluster_id").cast("string")
    failed = F.col("error").isNotNull()

    def message(prefix: str) -> Column:
        return F.array(F.concat(F.lit(prefix), F.col("error")))

    parsed = (
        clusters.join(calls.select("cluster_id", "response", "error"), "cluster_id")
        .withColumn("r", reply)
        .select(
            "cluster_id",
            "size",
            F.when(failed, F.concat(F.lit(C.FAILED_TOPIC), cid))
            .otherwise(F.coalesce("r.topic", F.lit(C.MISSING_TOPIC))).alias("topic"),
            F.when(failed, F.concat(F.lit(C.FAILED_TOPIC_EN), cid))
            .otherwise(F.coalesce("r.topic_en", F.lit(C.MISSING_TOPIC_EN))).alias("topic_en"),
            F.when(failed, message(C.FAILED_SUMMARY)).otherwise(_texts("r.summary"))
            .alias("summary"),
            F.when(failed, message(C.FAILED_SUMMARY_EN)).otherwise(_texts("r.summary_en"))
            .alias("summary_en"),
            F.coalesce("r.sentiment", F.lit(C.DEFAULT_SENTIMENT)).alias("sentiment"),
            _texts("r.keywords_ko").alias("keywords_ko"),
            _texts("r.keywords_en").alias("keywords_en"),
            F.when(
                F.size(_texts("r.representative_quote_ids")) > 0,
                F.col("r.representative_quote_ids"),
            ).otherwise(
                F.slice("representatives", 1, 3).cast("array<string>")
            ).alias("quote_ids"),
        )
    )
    quotes = resolve_quotes(parsed, ["cluster_id"], reviews)
    return parsed.drop("quote_ids").join(
        quotes.withColumnRenamed("quotes", "representative_quotes"), "cluster_id"
    )


def parse_issues(calls: DataFrame) -> DataFrame:
    """cluster_id, pos, the issue fields with defaults, quote_ids: one row per issue in replies."""
    reply = F.from_json("response", ISSUE_REPLY, {"mode": "PERMISSIVE"})
    failed = calls.where(F.col("error").isNotNull()).select(
        "cluster_id",
        F.lit(0).alias("pos"),
        F.lit(C.FAILED_ISSUE).alias("title"),
        F.lit(C.FAILED_ISSUE_EN).alias("title_en"),
        F.col("error").alias("description"),
        F.col("error").alias("description_en"),
        F.lit(C.DEFAULT_SEVERITY).alias("severity"),
        F.lit(0).alias("frequency"),
        F.array().cast("array<string>").alias("quote_ids"),
    )
    found = (
        calls.where(F.col("error").isNull())
        .select("cluster_id", F.posexplode(reply["issues"]).alias("pos", "i"))
        .select(
            "cluster_id",
            "pos",
            F.coalesce("i.title", F.lit(C.MISSING_TOPIC)).alias("title"),
            F.coalesce("i.title_en", F.lit(C.MISSING_TOPIC_EN)).alias("title_en"),
            F.coalesce("i.description", F.lit("")).alias("description"),
            F.coalesce("i.description_en", F.lit("")).alias("description_en"),
            F.coalesce("i.severity", F.lit(C.DEFAULT_SEVERITY)).alias("severity"),
            # a number with a fraction is cut, as an integer conversion does
            F.coalesce(
                F.expr("try_cast(try_cast(i.frequency AS DOUBLE) AS INT)"), F.lit(0)
            ).alias("frequency"),
            _texts("i.representative_quote_ids").alias("quote_ids"),
        )
    )
    return found.unionByName(failed)


def negative_records(
    counts: DataFrame, topics: DataFrame, issues: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Negative records: counts (cluster_id, negative_review_count) and topic names per cluster,
    with the issues (as from parse_issues) nested in order."""
    keys = ["cluster_id", "pos"]
    issues = pin(issues)
    quoted = issues.drop("quote_ids").join(resolve_quotes(issues, keys, reviews), keys)
    nested = quoted.groupBy("cluster_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos", "title", "title_en", "description", "description_en", "severity",
                    "frequency", F.col("quotes").alias("representative_quotes"),
                )
            )
        ).alias("_issues")
    )
    shape = (
        "array<struct<title:string,title_en:string,description:string,description_en:string,"
        "severity:string,frequency:int,"
        "representative_quotes:array<struct<review_id:bigint,text:string>>>>"
    )
    plain = F.transform("_issues", lambda i: i.dropFields("pos")).cast(shape)
    return (
        topics.select("cluster_id", "topic", "topic_en")
        .join(counts.select("cluster_id", "negative_review_count"), "cluster_id", "left")
        .join(nested, "cluster_id", "left")
        .select(
            "cluster_id",
            "topic",
            "topic_en",
            F.coalesce("negative_review_count", F.lit(0)).alias("negative_review_count"),
            F.coalesce(plain, F.array().cast(shape)).alias("issues"),
        )
    )
