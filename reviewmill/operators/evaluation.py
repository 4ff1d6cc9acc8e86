"""Checks on data: paraphrase agreement, recall on injected spam, and damage to inject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.functions import text as X
from reviewmill.operators.embedding import embed_reviews
from reviewmill.operators.placement import nearest_centroid


def place_reviews(reviews: DataFrame, embed_fn, centroids: DataFrame) -> DataFrame:
    """Embed new texts and give each its nearest cluster: the input with cluster_id, similarity."""
    embedded = embed_reviews(reviews, embed_fn).drop("call_tokens", "opens_call")
    return nearest_centroid(embedded, centroids).drop("embedding")


def paraphrase_agreement(probes: DataFrame, centroids: DataFrame) -> DataFrame:
    """probe_group, probes, clusters, agrees: do all probes of a group share their nearest cluster?

    probes: probe_group and embedding.
    """
    placed = nearest_centroid(probes.select("probe_group", "embedding"), centroids)
    per_cluster = placed.groupBy("probe_group", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return per_cluster.groupBy("probe_group").agg(
        F.sum("n").alias("probes"),
        F.count(F.lit(1)).alias("clusters"),
        (F.count(F.lit(1)) == 1).alias("agrees"),
    )


def variants(reviews: DataFrame, phrases: list[str]) -> DataFrame:
    """probe_group, variant, text: four ways to say what each review says. As it stands; with its encoding damaged and
    repaired; with one of the phrases behind it, by id; with its words in reverse order, each as often as before."""
    phrase = F.element_at(
        F.array(*[F.lit(p) for p in phrases]), (F.pmod("review_id", F.lit(len(phrases))) + 1).cast("int"))
    damaged = X.corrupt(X.as_text(F.col("text")))
    again = X.redecoded(damaged)
    said = [
        ("plain", F.col("text")),
        ("repaired", F.when(X.is_better(again, damaged), again).otherwise(damaged)),
        ("longer", F.concat_ws(" ", X.as_text(F.col("text")), phrase)),
        ("reversed", F.array_join(F.reverse(F.split(X.as_text(F.col("text")), r"\s+")), " ")),
    ]
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), t.alias("text")) for n, t in said])).alias("v")
    return reviews.select(F.col("review_id").alias("probe_group"), told).select("probe_group", "v.variant", "v.text")


def append_rows(rows: DataFrame, injected: DataFrame) -> DataFrame:
    return rows.unionByName(injected)


def recall(flags: DataFrame, injected: DataFrame) -> DataFrame:
    """injected, caught, recall over the injected ids."""
    return flags.join(injected.select("review_id"), "review_id", "left_semi").agg(
        F.count(F.lit(1)).alias("injected"),
        F.count_if("is_spam").alias("caught"),
        F.avg(F.col("is_spam").cast("int")).alias("recall"),
    )


def _every(n: int) -> Column:
    return F.pmod("review_id", F.lit(n)) == 0


def inject_mojibake(reviews: DataFrame, every: int = 33) -> DataFrame:
    """Damage the text of every n-th id."""
    damaged = F.when(_every(every), X.corrupt(F.col("text"))).otherwise(F.col("text"))
    return reviews.withColumn("text", damaged)


def inject_spam(reviews: DataFrame, phrases: list[str], every: int = 20) -> DataFrame:
    """Replace the text of every n-th id by one of the phrases."""
    pick = F.element_at(
        F.array(*[F.lit(p) for p in phrases]),
        (F.pmod("review_id", F.lit(len(phrases))) + 1).cast("int"),
    )
    return reviews.withColumn("text", F.when(_every(every), pick).otherwise(F.col("text")))
