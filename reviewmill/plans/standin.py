"""Review-shaped views over a folder of document, label and vector tables.

Each table holds part of what a review needs: texts with languages, a quality label for some of
them, and vectors with a given cluster. See FIXTURES.md for the mapping.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill.constants import OTHER_CLUSTER_ID
from reviewmill.operators.scale import materialize, pin

POSITIVE_LABELS = 5
PROTOTYPE_LABELS = 8


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

        self._read: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    @cached_property
    def texts(self) -> DataFrame:
        """review_id, text, lang, playtime_hours, posted_at: the documents alone. Answers are joined
        only where they are asked for, so a text query moves no text."""
        return self.read("documents").select(
            F.col("doc_id").alias("review_id"),
            "text",
            "lang",
            (F.col("n_chars") / F.lit(100.0)).alias("playtime_hours"),
            F.lit(None).cast("string").alias("posted_at"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """The texts with recommended, which is NULL without a label."""
        return self.texts.join(self.answers, "review_id", "left").select(
            "review_id", "text", "lang", "recommended", "playtime_hours", "posted_at"
        )

    @property
    def ids(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").alias("review_id"))

    @property
    def vectors(self) -> DataFrame:
        """review_id, embedding, cluster_id (the given one)."""
        return self.read("embeddings").select(
            F.col("vec_id").alias("review_id"), "embedding", F.col("label").alias("cluster_id")
        )

    @property
    def answers(self) -> DataFrame:
        """review_id, recommended of the labelled reviews; no text is read for it."""
        return self.read("labels").select(
            F.col("doc_id").alias("review_id"), (F.col("quality") == 1).alias("recommended")
        )

    @cached_property
    def flagged(self) -> tuple[DataFrame, float]:
        from reviewmill.operators.spam import detect_spam

        return detect_spam(self.texts, self.vectors, self.prototypes)

    @property
    def answered(self) -> DataFrame:
        """review_id, cluster_id, recommended of every review; of the texts only ids are read. A
        review without a given cluster is in the "other" one."""
        return (
            self.ids.join(self.vectors.select("review_id", "cluster_id"), "review_id", "left")
            .join(self.answers, "review_id", "left")
            .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(OTHER_CLUSTER_ID)))
        )

    @cached_property
    def active_answered(self) -> DataFrame:
        """The same of the reviews that are no spam."""
        from reviewmill.operators.spam import active_reviews

        return materialize(active_reviews(self.answered, self.flagged[0]))

    @cached_property
    def members(self) -> DataFrame:
        """The reviews that are no spam, with answer, vector (NULL without one) and cluster: joined
        once and stored as whole rows, which the passes over texts and vectors then read column by
        column."""
        return materialize(
            self.texts.join(self.active_answered, "review_id")
            .join(self.vectors.select("review_id", "embedding"), "review_id", "left")
        )

    @cached_property
    def term_counts(self) -> DataFrame:
        from reviewmill.operators.extractive import default_stop_words, review_term_counts

        return review_term_counts(self.members, default_stop_words())

    @property
    def prototype_rows(self) -> DataFrame:
        """pid, polarity, text, embedding: the vector with the lowest id of each of eight labels."""
        vectors = self.vectors
        firsts = pin(
            vectors.where(F.col("cluster_id") < PROTOTYPE_LABELS)
            .groupBy("cluster_id").agg(F.min("review_id").alias("review_id"))
        )
        polarity = F.when(F.col("pid") < POSITIVE_LABELS, "positive").otherwise("negative")
        return (
            vectors.join(firsts.select("review_id"), "review_id")
            .withColumn("pid", F.col("cluster_id"))
            .select(
                "pid", polarity.alias("polarity"),
                F.concat(F.lit("prototype "), F.col("pid").cast("string")).alias("text"),
                "embedding",
            )
        )

    @cached_property
    def prototypes(self) -> tuple[list[str], np.ndarray, int]:
        from reviewmill.operators.spam import load_prototypes

        return load_prototypes(self.prototype_rows)
