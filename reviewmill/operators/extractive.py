"""Topics and complaints without an outside model: class-based TF-IDF, counts and rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill import constants as C
from reviewmill.functions import text as X
from reviewmill.functions.labels import is_negative, severity_rank
from reviewmill.operators.scale import materialize, pin, top_n_per_group
from reviewmill.operators.selection import cluster_centroids, nearest_per_cluster

TERM_PATTERN = r"[\p{L}\p{N}]{2,}"
BLOCKER_PATTERN = r"(crash|freez|won.t (start|launch)|cannot progress|game.?breaking)"
MAX_ISSUES = 5
MAJOR_SHARE = 0.2
POSITIVE_SHARE = 0.7
NEGATIVE_SHARE = 0.3
STOP_WORD_LANGUAGES = ("english", "french", "german", "spanish")
KOREAN_STOP_WORDS = (
    "그리고 그러나 그런데 그래서 하지만 또한 또는 및 이런 저런 그런 이것 저것 그것 여기 저기 거기 우리 제가 내가 너무 정말 진짜 "
    "아주 매우 조금 그냥 다시 계속 이미 아직 같은 같이 때문에 위해 대한 대해 통해 있는 있다 있고 있어 없는 없다 없고 하는 한다 하고 "
    "해서 하면 되는 된다 되고 합니다 입니다 이다 였다 에서 으로 부터 까지 보다 처럼"
).split()


def default_stop_words(languages: Iterable[str] = STOP_WORD_LANGUAGES) -> list[str]:
    """Spark's own stop-word lists, and one for Korean, which Spark lacks."""
    words = {w for l in languages for w in StopWordsRemover.loadDefaultStopWords(l)}
    return sorted(words | set(KOREAN_STOP_WORDS))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def review_term_counts(members: DataFrame, stop_words: Iterable[str] = ()) -> DataFrame:
    """cluster_id, negative, term, tf, stored: the one pass over the texts that both the topics
    and the complaints are made from. Counting happens before any row moves.

    members: cluster_id, text, recommended.
    """
    exploded = members.select(
        "cluster_id",
        is_negative(F.col("recommended")).alias("negative"),
        F.explode(terms_of(F.col("text"))).alias("term"),
    )
    words = list(stop_words)
    if words:
        stop = members.sparkSession.createDataFrame([(w,) for w in words], "term string")
        exploded = exploded.join(F.broadcast(stop), "term", "left_anti")  # a fixed word list
    return materialize(
        exploded.groupBy("cluster_id", "negative", "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def class_weights(counts: DataFrame, label: Column) -> DataFrame:
    """label, term, tf, weight with weight = tf * ln(1 + mean tokens per class / term count)."""
    merged = counts.groupBy(label.alias("label"), "term").agg(F.sum("tf").alias("tf"))
    # NULL is a class of its own; there are as many rows here as classes
    per_class = counts.groupBy(label.alias("label")).agg(F.sum("tf").alias("n"))
    mean_tokens = per_class.agg(F.avg("n")).first()[0] or 0.0
    total = F.sum("tf").over(Window.partitionBy("term"))
    weight = F.col("tf") * F.ln(F.lit(1.0) + F.lit(float(mean_tokens)) / total)
    return merged.select("label", "term", "tf", weight.alias("weight"))


def cluster_keywords(counts: DataFrame, n: int = 10) -> DataFrame:
    """cluster_id, rank, term, tf, weight: the n heaviest terms of each cluster."""
    weighted = class_weights(counts, F.col("cluster_id")).withColumnRenamed("label", "cluster_id")
    return top_n_per_group(weighted, ["cluster_id"], [F.desc("weight"), F.asc("term")], n)


def cluster_sentiment(members: DataFrame) -> DataFrame:
    """cluster_id, recommended_share, sentiment from the answers given; no answer means mixed."""
    share = F.col("recommended_share")
    return (
        members.groupBy("cluster_id")
        .agg(F.avg(F.col("recommended").cast("int")).alias("recommended_share"))
        .withColumn(
            "sentiment",
            F.when(share >= POSITIVE_SHARE, "positive")
            .when(share <= NEGATIVE_SHARE, "negative")
            .otherwise(C.DEFAULT_SENTIMENT),
        )
    )


def extractive_topics(
    members: DataFrame, counts: DataFrame, picks: DataFrame, sizes: DataFrame, n_terms: int = 10
) -> DataFrame:
    """Topic records. members: review_id, cluster_id, text, recommended; counts: their
    review_term_counts; picks: cluster_id, review_id, rank (representatives); sizes: cluster_id,
    size.

    The topic is the three heaviest terms; Hangul terms fill keywords_ko, the others keywords_en;
    the summary and the quotes are the three nearest representatives.
    """
    keywords = (
        cluster_keywords(counts, n_terms)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_terms"))
        .select("cluster_id", F.col("_terms.term").alias("terms"))
    )
    quotes = (
        pin(picks.where("rank <= 3").select("cluster_id", "review_id", "rank"))
        .join(members.select("review_id", "text"), "review_id")
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "review_id", "text"))).alias("_q"))
    )
    name = F.array_join(F.slice("terms", 1, 3), " ")
    summary = F.transform("_q", lambda q: X.clip(q.text, C.REPORT_QUOTE_CHARS))
    return (
        sizes.select("cluster_id", "size")
        .join(keywords, "cluster_id", "left")
        .join(cluster_sentiment(members), "cluster_id", "left")
        .join(quotes, "cluster_id", "left")
        .select(
            F.col("cluster_id").cast("int").alias("cluster_id"),
            F.col("size").cast("bigint").alias("size"),
            F.coalesce(name, F.lit(C.MISSING_TOPIC)).alias("topic"),
            F.coalesce(name, F.lit(C.MISSING_TOPIC_EN)).alias("topic_en"),
            summary.alias("summary"),
            summary.alias("summary_en"),
            F.coalesce("sentiment", F.lit(C.DEFAULT_SENTIMENT)).alias("sentiment"),
            F.filter("terms", lambda t: t.rlike(f"[{C.HANGUL_CHARS}]")).alias("keywords_ko"),
            F.filter("terms", lambda t: ~t.rlike(f"[{C.HANGUL_CHARS}]")).alias("keywords_en"),
            F.transform(
                "_q", lambda q: F.struct(q.review_id.alias("review_id"), q.text.alias("text"))
            ).alias("representative_quotes"),
        )
    )


def negative_counts(members: DataFrame) -> DataFrame:
    """cluster_id, size, negative_review_count, negative_ratio."""
    return (
        members.groupBy("cluster_id")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.count_if(is_negative(F.col("recommended"))).alias("negative_review_count"),
        )
        .withColumn(
            "negative_ratio",
            F.col("negative_review_count") / F.greatest(F.col("size"), F.lit(1)),
        )
    )


def extractive_issues(
    members: DataFrame,
    term_counts: DataFrame,
    min_negatives: int = C.MIN_NEGATIVES,
    max_issues: int = MAX_ISSUES,
) -> DataFrame:
    """Issue rows in the shape of parsed replies: cluster_id, pos, title, title_en, description,
    description_en, severity, frequency, quote_ids.

    members: review_id, cluster_id, text, recommended, embedding; term_counts: their
    review_term_counts. Classes are the negatives of each cluster, and all other reviews as one.
    The heaviest terms of a class are its issues; their frequency is the number of negatives that
    contain the term. Vectors and texts stay in their rows throughout.
    """
    counts = pin(
        negative_counts(members.select("cluster_id", "recommended"))
        .where(F.col("negative_review_count") >= min_negatives)
        .select("cluster_id", "negative_review_count")
    )
    weighted = class_weights(
        term_counts, F.when(F.col("negative"), F.col("cluster_id"))
    ).withColumnRenamed("label", "cluster_id")
    terms = top_n_per_group(
        weighted.join(counts.select("cluster_id"), "cluster_id", "left_semi"),
        ["cluster_id"], [F.desc("weight"), F.asc("term")], max_issues,
    )
    number = F.col("cluster_id") * (max_issues + 1) + F.col("rank")
    issues = pin(terms.select("cluster_id", "term", number.cast("int").alias("issue_id")))
    wanted = pin(
        issues.groupBy("cluster_id").agg(
            F.collect_list(F.struct("issue_id", "term")).alias("wanted")
        )
    )
    negatives = members.where(is_negative(F.col("recommended"))).join(wanted, "cluster_id")
    # the one pass over the texts; what it finds is stored as ids
    mentions = materialize(
        negatives.withColumn("_terms", terms_of(F.col("text")))
        .withColumn(
            "issue_id",
            F.explode(
                F.filter("wanted", lambda w: F.array_contains("_terms", w.term)).issue_id
            ),
        )
        .select("issue_id", "review_id", F.lower("text").rlike(BLOCKER_PATTERN).alias("blocks"))
    )
    facts = mentions.groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("frequency"), F.max("blocks").alias("blocks")
    )
    placed = negatives.where("embedding IS NOT NULL").select("review_id", "cluster_id", "embedding")
    centroids = cluster_centroids(placed)
    issue_centroids = pin(
        issues.join(centroids, "cluster_id")
        .select(F.col("issue_id").alias("cluster_id"), "centroid")
    )
    quotes = (
        nearest_per_cluster(
            placed.select("review_id", "embedding").join(
                mentions.select("review_id", F.col("issue_id").alias("cluster_id")), "review_id"
            ),
            3,
            issue_centroids,
        )
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "review_id"))).alias("_q"))
        .select(
            F.col("cluster_id").alias("issue_id"),
            F.col("_q.review_id").cast("array<string>").alias("quote_ids"),
        )
    )
    severity = (
        F.when(F.col("blocks"), "critical")
        .when(F.col("frequency") >= MAJOR_SHARE * F.col("negative_review_count"), "major")
        .otherwise("minor")
    )
    by_cluster = Window.partitionBy("cluster_id").orderBy(
        F.desc("frequency"), severity_rank(F.col("severity")), "term"
    )
    sentence = F.format_string(
        "%d of %d negative reviews mention \"%s\".", "frequency", "negative_review_count", "term"
    )
    return (
        issues.join(counts, "cluster_id")
        .join(facts, "issue_id")
        .join(quotes, "issue_id", "left")
        .withColumn("severity", severity)
        .select(
            "cluster_id",
            (F.row_number().over(by_cluster) - 1).alias("pos"),
            F.col("term").alias("title"),
            F.col("term").alias("title_en"),
            sentence.alias("description"),
            sentence.alias("description_en"),
            "severity",
            F.col("frequency").cast("int").alias("frequency"),
            F.coalesce("quote_ids", F.array().cast("array<string>")).alias("quote_ids"),
        )
    )
