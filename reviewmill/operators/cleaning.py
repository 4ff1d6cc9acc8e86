"""Cleaning: mojibake repair, blank removal, and the numbers reported about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from reviewmill import constants as C
from reviewmill.functions import text as X


def repair(reviews: DataFrame) -> DataFrame:
    """Repair the text; keeps what it was in original_text and says so in was_repaired."""
    return (
        reviews.withColumn("original_text", X.as_text(F.col("text")))
        .withColumn("_candidate", X.redecoded(F.col("original_text")))
        .withColumn("was_repaired", X.is_better(F.col("_candidate"), F.col("original_text")))
        .withColumn(
            "text",
            F.when(F.col("was_repaired"), F.col("_candidate")).otherwise(F.col("original_text")),
        )
        .drop("_candidate")
    )


def drop_blank(reviews: DataFrame) -> DataFrame:
    return reviews.where(~X.is_blank(F.col("text")))


def clean(reviews: DataFrame) -> DataFrame:
    """The cleaned review table."""
    return drop_blank(repair(reviews).drop("original_text", "was_repaired"))


def _stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("input_count"),
        F.count_if(~X.is_blank(F.col("text"))).alias("output_count"),
        F.count_if("was_repaired").alias("encoding_repaired"),
    ]


def clean_stats(reviews: DataFrame) -> DataFrame:
    """One row: rows in, rows kept, rows repaired."""
    return repair(reviews).agg(*_stats())


def clean_observed(reviews: DataFrame, observation: Observation) -> DataFrame:
    """The cleaned review table; writing it also fills the observation with the clean stats."""
    counted = repair(reviews).observe(observation, *_stats())
    return drop_blank(counted.drop("original_text", "was_repaired"))


def language_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("lang").agg(F.count(F.lit(1)).alias("review_count"))


def repair_examples(reviews: DataFrame, n: int = C.MAX_REPAIR_EXAMPLES) -> DataFrame:
    """The first repaired rows by id, before and after, shortened for display."""
    return (
        repair(reviews)
        .where("was_repaired")
        .select(
            "review_id",
            F.substring("original_text", 1, C.EXAMPLE_CHARS).alias("before"),
            F.substring("text", 1, C.EXAMPLE_CHARS).alias("after"),
        )
        .orderBy("review_id")
        .limit(n)
    )
