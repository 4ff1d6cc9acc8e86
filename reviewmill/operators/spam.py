"""Two-sided zero-shot spam flags: nearness to spam and genuine prototypes, or a URL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from reviewmill import constants as C
from reviewmill.functions import text as X, vectors as V
from reviewmill.operators.scale import exact_quantile, materialize

MAX_PROTOTYPES = 1000


def load_prototypes(prototypes: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """Bring the handful of prototypes to the driver: names, matrix, number of positive rows.

    Expects (pid, polarity, text, embedding); positives come first, each side ordered by pid. More
    than MAX_PROTOTYPES rows are refused.
    """
    rows = prototypes.select("pid", "polarity", "text", "embedding").limit(MAX_PROTOTYPES + 1).collect()
    if len(rows) > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    rows.sort(key=lambda r: (r["polarity"] != "positive", r["pid"]))
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    return [r["text"] for r in rows], matrix, sum(r["polarity"] == "positive" for r in rows)


def prototype_similarities(vectors: DataFrame, prototypes) -> DataFrame:
    """Adds sim_pos, sim_neg and matched_prototype (first of the best positives); no shuffle."""
    names, matrix, positives = prototypes
    first_negative, negatives = positives + 1, len(names) - positives
    name_list = F.array(*[F.lit(n) for n in names])
    return (
        vectors.withColumn("_sims", V.cosine_to_all(F.col("embedding"), matrix))
        .withColumn("sim_pos", F.array_max(F.slice("_sims", 1, positives)))
        .withColumn("sim_neg", F.array_max(F.slice("_sims", first_negative, negatives)))
        .withColumn(
            "matched_prototype",
            F.element_at(name_list, F.array_position("_sims", F.col("sim_pos")).cast("int")),
        )
        .drop("_sims")
    )


def spam_scores(reviews: DataFrame, vectors: DataFrame, prototypes) -> DataFrame:
    """review_id, sim_pos, sim_neg, matched_prototype, has_url of every review.

    Only the id and one boolean of each review take part in the join; the text stays in place. A
    review without a vector has no similarities.
    """
    sims = prototype_similarities(vectors.select("review_id", "embedding"), prototypes)
    marked = reviews.select("review_id", X.has_url(F.col("text")).alias("has_url"))
    return marked.join(sims.drop("embedding"), "review_id", "left")


def score_rows(rows: DataFrame, prototypes) -> DataFrame:
    """The same scores for rows that hold text and embedding side by side: no join at all."""
    return prototype_similarities(rows, prototypes).withColumn(
        "has_url", X.has_url(F.col("text"))
    )


def positive_threshold(
    scores: DataFrame,
    target_ratio: float = C.TARGET_SPAM_RATIO,
    floor: float = C.MIN_POSITIVE_SIMILARITY,
) -> float:
    """The similarity that about target_ratio of the rows exceed, but never less than floor."""
    found = exact_quantile(scores, "sim_pos", 1.0 - target_ratio)
    return max(1.0 if found is None else found, floor)


def is_spam(threshold: float, min_gap: float = C.MIN_SIMILARITY_GAP) -> Column:
    """The decision on scored rows, from unrounded values: near to spam, or a URL. Without a vector
    only the URL decides."""
    near = (F.col("sim_pos") >= threshold) & (F.col("sim_pos") - F.col("sim_neg") >= min_gap)
    return F.coalesce(near, F.lit(False)) | F.coalesce("has_url", F.lit(False))


def flag(scores: DataFrame, threshold: float, min_gap: float = C.MIN_SIMILARITY_GAP) -> DataFrame:
    """Flags with the scores rounded for display. Stateless for a given threshold."""
    boost = F.when(F.col("has_url"), C.URL_SCORE_BOOST).otherwise(0.0)
    return scores.select(
        "review_id",
        is_spam(threshold, min_gap).alias("is_spam"),
        F.round(F.col("sim_pos") - F.col("sim_neg") + boost, 4).alias("spam_score"),
        F.round("sim_pos", 4).alias("sim_pos"),
        F.round("sim_neg", 4).alias("sim_neg"),
        "has_url",
        "matched_prototype",
    )


def detect_spam(
    reviews: DataFrame,
    vectors: DataFrame,
    prototypes,
    target_ratio: float = C.TARGET_SPAM_RATIO,
    floor: float = C.MIN_POSITIVE_SIMILARITY,
    min_gap: float = C.MIN_SIMILARITY_GAP,
) -> tuple[DataFrame, float]:
    """Flags and the threshold used. Vectors are read once: the narrow scores are kept."""
    scores = materialize(spam_scores(reviews, vectors, prototypes))
    threshold = positive_threshold(scores, target_ratio, floor)
    return flag(scores, threshold, min_gap), threshold


def spam_stats(
    flags: DataFrame, threshold: float, min_gap: float = C.MIN_SIMILARITY_GAP
) -> DataFrame:
    return flags.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_spam").alias("spam_count"),
        F.avg(F.col("is_spam").cast("int")).alias("spam_ratio"),
        F.lit(threshold).alias("threshold_pos"),
        F.lit(min_gap).alias("threshold_diff"),
        F.count_if("has_url").alias("url_boost_count"),
    )


def active_reviews(reviews: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows that are not flagged."""
    return reviews.join(flags.where("is_spam").select("review_id"), "review_id", "left_anti")


def spam_candidates(flags: DataFrame, reviews: DataFrame) -> DataFrame:
    """What a person reviews: flagged rows with their text, highest score first."""
    return (
        flags.where("is_spam")
        .join(reviews.select("review_id", "text"), "review_id", "left")
        .select(
            "review_id",
            F.coalesce("spam_score", F.lit(0.0)).alias("score"),
            "matched_prototype",
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .orderBy(F.desc("score"), "review_id")
    )


def override_flags(flags: DataFrame, false_positives: DataFrame) -> DataFrame:
    """Clear is_spam on the ids that a person marked as not spam."""
    cleared = false_positives.select("review_id").distinct().withColumn("_cleared", F.lit(True))
    return (
        flags.join(cleared, "review_id", "left")
        .withColumn("is_spam", F.col("is_spam") & F.col("_cleared").isNull())
        .drop("_cleared")
    )
