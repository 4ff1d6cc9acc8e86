"""What readers browse: filtered and paged reviews, ranked topics and issues, key figures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill import constants as C
from reviewmill.functions import labels as L
from reviewmill.operators.scale import exact_rank_value, pin


def attach_cluster(
    reviews: DataFrame, assignments: DataFrame, default: int | None = None
) -> DataFrame:
    """Adds cluster_id; reviews without an assignment get the default, or NULL."""
    joined = reviews.join(assignments.select("review_id", "cluster_id"), "review_id", "left")
    if default is None:
        return joined
    return joined.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(default)))


def explorer_filter(
    reviews: DataFrame,
    clusters: Iterable[int] = (),
    langs: Iterable[str] = (),
    recommended: bool | None = None,
    playtime: tuple[float, float] | None = None,
    search: str = "",
) -> DataFrame:
    """Each criterion narrows the rows; an empty one does not. The search is a plain,
    case-insensitive substring. A playtime range excludes rows without a playtime."""
    clusters, langs = list(clusters), list(langs)
    view = reviews
    if clusters:
        view = view.where(F.col("cluster_id").isin(clusters))
    if langs:
        view = view.where(F.col("lang").isin(langs))
    if recommended is not None:
        view = view.where(F.col("recommended") == recommended)
    if playtime is not None:
        view = view.where(F.col("playtime_hours").between(*playtime))
    if search.strip():
        view = view.where(F.lower("text").contains(search.lower()))
    return view


def explorer_facets(reviews: DataFrame) -> DataFrame:
    """facet, value, reviews: what the filters can choose from. A row per cluster and language with
    the number of reviews, and the largest playtime with the number of reviews that have one.

    Three narrow columns are read, no texts.
    """
    cluster, lang = F.col("cluster_id").cast("string"), F.col("lang")
    named = reviews.select(
        F.explode(F.array(
            F.struct(F.lit("cluster").alias("facet"), cluster.alias("value")),
            F.struct(F.lit("lang").alias("facet"), lang.alias("value")),
        )).alias("f")
    ).where("f.value IS NOT NULL").groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("reviews"))
    longest = reviews.agg(
        F.lit("max_playtime").alias("facet"), F.max("playtime_hours").cast("string").alias("value"),
        F.count("playtime_hours").alias("reviews"),
    )
    return named.unionByName(longest)


def page_count(df: DataFrame, size: int = C.PAGE_SIZE) -> DataFrame:
    """One row: total rows and number of pages, at least one."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).alias("max_page"),
    )


def page(df: DataFrame, number: int, size: int = C.PAGE_SIZE) -> DataFrame:
    """The given page (from 1) by review_id, ids that are NULL last, equal ids by a hash of the row.

    The id at which the page starts is found from the id column alone; then only rows from that id
    on are ordered, and of those before the page at most the ones that share its first id.
    """
    start = (number - 1) * size
    first = exact_rank_value(df, "review_id", start)
    if first is None:
        before, rest = df.where("review_id IS NOT NULL").count(), F.col("review_id").isNull()
    else:
        before = df.where(F.col("review_id") < F.lit(first)).count()
        rest = F.col("review_id").isNull() | (F.col("review_id") >= F.lit(first))
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    order = [F.col("review_id").asc_nulls_last(), tie, *[F.col(c) for c in df.columns]]
    return df.where(rest).orderBy(*order).offset(start - before).limit(size)


def topic_ranking(
    topics: DataFrame,
    counts: DataFrame,
    by: str = "size",
    sentiments: Iterable[str] = ("positive", "negative", "mixed"),
) -> DataFrame:
    """Topics with their negative ratio, by size or by negative ratio, largest first."""
    if by not in ("size", "negative_ratio"):
        raise ValueError("by must be size or negative_ratio")
    sentiment = F.coalesce("sentiment", F.lit(C.DEFAULT_SENTIMENT))
    return (
        topics.where(sentiment.isin(list(sentiments)))
        .join(counts.select("cluster_id", "negative_review_count"), "cluster_id", "left")
        .withColumn("size", F.coalesce("size", F.lit(0)))
        .withColumn(
            "negative_ratio",
            F.coalesce("negative_review_count", F.lit(0)) / F.greatest(F.col("size"), F.lit(1)),
        )
        .select(
            "cluster_id", "size", "topic", "topic_en", sentiment.alias("sentiment"),
            L.sentiment_icon(F.col("sentiment")).alias("icon"), "negative_ratio",
        )
        .orderBy(F.desc(by), "cluster_id")
    )


def topic_details(topics: DataFrame, quotes: int = C.VIEW_QUOTES) -> DataFrame:
    """Topics with at most the given number of quotes."""
    return topics.withColumn(
        "representative_quotes", F.slice("representative_quotes", 1, quotes)
    )


def flatten_issues(negatives: DataFrame) -> DataFrame:
    """One row per issue, numbered from 1 inside its cluster, with defaults filled in."""
    flat = negatives.select(
        "cluster_id", "topic", "negative_review_count", F.posexplode("issues").alias("pos", "i")
    )
    return flat.select(
        "cluster_id",
        F.coalesce("topic", F.lit("-")).alias("topic"),
        "negative_review_count",
        (F.col("pos") + 1).alias("issue_no"),
        F.coalesce("i.title", F.lit("-")).alias("title"),
        F.coalesce("i.title_en", F.lit("-")).alias("title_en"),
        F.coalesce("i.description", F.lit("")).alias("description"),
        F.coalesce("i.description_en", F.lit("")).alias("description_en"),
        F.coalesce("i.severity", F.lit(C.DEFAULT_SEVERITY)).alias("severity"),
        F.coalesce("i.frequency", F.lit(0)).alias("frequency"),
        F.col("i.representative_quotes").alias("representative_quotes"),
    )


def issue_ranking(negatives: DataFrame) -> DataFrame:
    """Issues of all clusters, most severe and then most frequent first."""
    rank: Column = L.severity_rank(F.col("severity"))
    return (
        flatten_issues(negatives)
        .withColumn("severity_rank", rank)
        .withColumn("severity_label", L.severity_label(F.col("severity")))
        .withColumn("representative_quotes", F.slice("representative_quotes", 1, C.VIEW_QUOTES))
        .orderBy("severity_rank", F.desc("frequency"), "cluster_id", "issue_no")
    )


def total_issues(negatives: DataFrame) -> DataFrame:
    return negatives.agg(
        F.coalesce(F.sum(F.coalesce(F.size("issues"), F.lit(0))), F.lit(0)).alias("total_issues")
    )


def kpi_summary(
    clean: DataFrame, spam: DataFrame, clusters: DataFrame, negatives: DataFrame, cost: DataFrame
) -> DataFrame:
    """metric, value from the one-row stats of the stages: clean (input_count, output_count,
    encoding_repaired), spam (spam_count, spam_ratio), clusters (k, sample_silhouette), negatives
    (negative_review_count per cluster), cost (total_cost_usd)."""

    def unpivot(df: DataFrame, *metrics: str) -> DataFrame:
        parts = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
        return df.selectExpr(f"stack({len(metrics)}, {parts}) AS (metric, value)")

    measured = unpivot(clean, "input_count", "output_count", "encoding_repaired")
    measured = measured.unionByName(unpivot(spam, "spam_count", "spam_ratio"))
    measured = measured.unionByName(unpivot(clusters, "k", "sample_silhouette"))
    measured = measured.unionByName(
        unpivot(
            negatives.agg(
                F.coalesce(F.sum("negative_review_count"), F.lit(0)).alias("negative_count")
            ),
            "negative_count",
        )
    )
    measured = measured.unionByName(unpivot(cost, "total_cost_usd"))
    measured = pin(measured)
    # normal reviews = kept minus spam, as one more metric from the same rows
    normal = measured.where(F.col("metric").isin("output_count", "spam_count")).agg(
        F.lit("normal_count").alias("metric"),
        F.sum(
            F.when(F.col("metric") == "spam_count", -F.col("value")).otherwise(F.col("value"))
        ).alias("value"),
    )
    return measured.unionByName(normal)

