"""Every operator applied to whole tables of a data folder: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill import constants as C
from reviewmill.functions import labels as L
from reviewmill.functions import text as X
from reviewmill.functions import vectors as V
from reviewmill.operators import (
    cleaning, clustering, embedding, enrichment, evaluation, export, extractive, ledger,
    phrases, placement, selection, spam, views,
)
from reviewmill.operators.scale import materialize, pin, shared_dir, uniform_sample
from reviewmill.operators.silhouette import euclidean_silhouette, squared_silhouette
from reviewmill.plans.standin import Tables
from reviewmill.sources import paged, text_index

TINY = 50

SPAM_PHRASES = [
    "Cheap keys at www.example.com, limited offer",
    "Buy accounts and gold, message me now",
    "Follow my channel for free skins",
    "Sponsored: best proxy service, code GAME10",
    "win win win win win win win",
]


# --- cleaning ------------------------------------------------------------------------


def clean_text_score(spark: SparkSession, folder: str) -> DataFrame:
    text = X.as_text(F.col("text"))
    return Tables(spark, folder).texts.select(
        "review_id", F.round(X.intactness(text), 6).alias("score")
    )


def mojibake_repair(spark: SparkSession, folder: str) -> DataFrame:
    damaged = evaluation.inject_mojibake(Tables(spark, folder).texts)
    return cleaning.repair(damaged).select("review_id", "text", "was_repaired")


def _blanked(reviews: DataFrame) -> DataFrame:
    """Every 40th text replaced by white space only."""
    blank = F.when(F.pmod("review_id", F.lit(40)) == 0, F.lit(" \t\n\u3000 "))
    return reviews.withColumn("text", blank.otherwise(F.col("text")))


def blank_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = _blanked(Tables(spark, folder).texts)
    return kept.select(
        "review_id",
        (~X.is_blank(F.col("text"))).alias("kept"),
        X.embeddable(F.col("text")).alias("embed_text"),
    )


def repair_examples(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.repair_examples(evaluation.inject_mojibake(Tables(spark, folder).texts))


def clean_stats(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_stats(_blanked(evaluation.inject_mojibake(Tables(spark, folder).texts)))


def lang_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.language_distribution(cleaning.clean(Tables(spark, folder).texts))


def url_marker(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    texts = tables.texts.select(F.lit("review").alias("kind"), "review_id", "text").unionByName(
        tables.read("pages").select(
            F.lit("page").alias("kind"), F.col("page_id").alias("review_id"),
            F.col("url").alias("text"),
        )
    )
    return texts.select("kind", "review_id", X.has_url(F.col("text")).alias("has_url"))


def clip_text(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return Tables(spark, folder).texts.select(
        "review_id",
        X.clip(text, C.TOPIC_PROMPT_CHARS).alias("topic_line"),
        X.clip(text, C.ISSUE_PROMPT_CHARS).alias("issue_line"),
        X.table_cell(X.clip(text, C.REPORT_QUOTE_CHARS)).alias("report_cell"),
        X.clip(text, C.TICKET_QUOTE_CHARS, ellipsis=False).alias("ticket_line"),
    )


def inject_spam(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.inject_spam(Tables(spark, folder).texts, SPAM_PHRASES).select(
        "review_id", "text", X.has_url(F.col("text")).alias("has_url")
    )


# --- spam ----------------------------------------------------------------------------


def cosine_to_prototypes(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return spam.prototype_similarities(
        tables.vectors.select("review_id", "embedding"), tables.prototypes
    ).select(
        "review_id", F.round("sim_pos", 4).alias("sim_pos"), F.round("sim_neg", 4).alias("sim_neg"),
        "matched_prototype",
    )


def spam_threshold(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    # similarities belong to vectors: the texts are not needed for the threshold
    scores = spam.spam_scores(tables.ids.withColumn("text", F.lit("")), tables.vectors, tables.prototypes)
    value = spam.positive_threshold(materialize(scores.select("sim_pos")))
    return spark.range(1).select(F.round(F.lit(value), 6).alias("threshold_pos"))


def _flags(tables: Tables) -> tuple[DataFrame, float]:
    return tables.flagged


def spam_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _flags(Tables(spark, folder))[0]


def spam_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = spam.spam_stats(*_flags(Tables(spark, folder)))
    return stats.withColumn("threshold_pos", F.round("threshold_pos", 6)).withColumn(
        "spam_ratio", F.round("spam_ratio", 6)
    )


def spam_candidates(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return spam.spam_candidates(_flags(tables)[0], tables.texts)


def spam_override(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews labelled as good stand for those that a person marked as not spam."""
    tables = Tables(spark, folder)
    cleared = tables.read("labels").where("quality = 1").select(F.col("doc_id").alias("review_id"))
    return spam.override_flags(_flags(tables)[0], cleared).select(
        "review_id", "is_spam", "has_url"
    )


def active_reviews(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    members = tables.answered.join(tables.texts.select("review_id", "lang"), "review_id")
    return spam.active_reviews(members, _flags(tables)[0])


def spam_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark sentences injected as reviews, with the vector of the same number."""
    tables = Tables(spark, folder)
    shifted = (F.col("item_id") + 900001).alias("review_id")
    items = tables.read("benchmark")
    injected = items.select(shifted, "text")
    vectors = items.join(
        tables.vectors.select(F.col("review_id").alias("item_id"), "embedding"), "item_id"
    ).select(shifted, "embedding")
    reviews = evaluation.append_rows(tables.texts.select("review_id", "text"), injected)
    all_vectors = evaluation.append_rows(tables.vectors.select("review_id", "embedding"), vectors)
    flags, _ = spam.detect_spam(reviews, all_vectors, tables.prototypes)
    return evaluation.recall(flags, injected).withColumn("recall", F.round("recall", 6))


def active_cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Clean, drop spam, then size and negative share of every given cluster."""
    tables = Tables(spark, folder)
    reviews = cleaning.clean(tables.texts)
    flags, _ = spam.detect_spam(reviews, tables.vectors, tables.prototypes)
    # the flags table covers the cleaned reviews, so the texts need not be read again
    kept = flags.where(~F.col("is_spam")).select("review_id")
    return extractive.negative_counts(kept.join(tables.answered, "review_id")).withColumn(
        "negative_ratio", F.round("negative_ratio", 6)
    )


# --- vectors and selection -------------------------------------------------------------


def cluster_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return selection.cluster_centroids(Tables(spark, folder).vectors).select(
        "cluster_id", "size", F.posexplode("centroid").alias("pos", "value")
    ).withColumn("value", F.round("value", 6))


def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    vectors = Tables(spark, folder).vectors
    placed = placement.nearest_centroid(
        vectors.select("review_id", "embedding"), selection.cluster_centroids(vectors)
    )
    return placed.select("review_id", "cluster_id", F.round("similarity", 4).alias("similarity"))


def nearest_per_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return selection.nearest_per_cluster(Tables(spark, folder).vectors, 5).withColumn(
        "score", F.round("score", 4)
    )


def mmr_per_cluster(spark: SparkSession, folder: str) -> DataFrame:
    vectors = Tables(spark, folder).vectors
    return selection.mmr_per_cluster(vectors, selection.nearest_per_cluster(vectors, 5), 5)


def representatives(spark: SparkSession, folder: str) -> DataFrame:
    return selection.representatives(Tables(spark, folder).vectors)


def _negative_vectors(tables: Tables) -> DataFrame:
    """Vectors of the reviews that say "not recommended"; no text is read for it."""
    negative = tables.read("labels").where("quality <> 1").select(
        F.col("doc_id").alias("review_id")
    )
    return tables.vectors.join(negative, "review_id", "left_semi")


def negative_sample(spark: SparkSession, folder: str) -> DataFrame:
    return selection.negative_sample(_negative_vectors(Tables(spark, folder)))


def tiny_cluster_merge(spark: SparkSession, folder: str) -> DataFrame:
    given = Tables(spark, folder).vectors.select("review_id", "cluster_id")
    return clustering.merge_tiny(given, TINY)


def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster_sizes(tiny_cluster_merge(spark, folder)).withColumn(
        "is_other", F.col("cluster_id") == C.OTHER_CLUSTER_ID
    )


def silhouette_exact(spark: SparkSession, folder: str) -> DataFrame:
    value = squared_silhouette(Tables(spark, folder).vectors)
    return spark.range(1).select(F.round(F.lit(value), 6).alias("silhouette"))


def silhouette_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    found = euclidean_silhouette(Tables(spark, folder).vectors)
    return spark.range(1).select(
        F.round(F.lit(found.value), 6).alias("silhouette"), F.lit(found.error).alias("error_bound")
    )


def uniform_sample_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = Tables(spark, folder).read("documents").select(F.col("doc_id").alias("review_id"))
    return uniform_sample(ids, 100, C.SEED)


def paraphrase_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Three neighbouring vectors at a time stand for paraphrases of one statement."""
    vectors = Tables(spark, folder).vectors
    probes = vectors.select(F.floor(F.col("review_id") / 3).alias("probe_group"), "embedding")
    return evaluation.paraphrase_agreement(probes, selection.cluster_centroids(vectors))


def variant_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Four variants of every text: do their offline vectors lie nearest to the same cluster? Clusters are the given ones."""
    tables = Tables(spark, folder)
    texts = tables.texts.select("review_id", "text")
    model = embedding.fit_offline_embedder(texts)
    known = embedding.embed_offline(model, texts).drop("text").join(
        tables.vectors.select("review_id", "cluster_id"), "review_id")
    probes = embedding.embed_offline(model, evaluation.variants(texts, SPAM_PHRASES))
    return evaluation.paraphrase_agreement(probes, pin(selection.cluster_centroids(known)))


# --- clustering (no SQL counterpart) -----------------------------------------------------


def pca_projection(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.pca_projection(Tables(spark, folder).vectors)


def pca_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every vector from the mean, measured after a projection that keeps all
    components: a rotation must not change it."""
    reduced = materialize(clustering.pca_projection(Tables(spark, folder).vectors, 64))
    center = selection.cluster_centroids(
        reduced.select(F.lit(0).alias("cluster_id"), F.col("reduced").alias("embedding"))
    ).first()["centroid"]
    gap = F.zip_with("reduced", F.lit(center), lambda x, c: x - c)
    return reduced.select("review_id", F.round(V.norm(gap), 4).alias("distance"))


def kmeans_assign(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.kmeans_assign(materialize(pca_projection(spark, folder)), C.K_MIN)


def kmeans_check(spark: SparkSession, folder: str) -> DataFrame:
    """Rows assigned, clusters, rows with a nearer center than their own, clusters out of order."""
    reduced = materialize(pca_projection(spark, folder))
    labelled = materialize(clustering.kmeans_assign(reduced, C.K_MIN).join(reduced, "review_id"))
    members = labelled.withColumnRenamed("reduced", "embedding")
    centers = selection.cluster_centroids(members).select(
        F.col("cluster_id").alias("other"), "centroid"
    )
    gap = V.dot(*[F.zip_with("embedding", "centroid", lambda x, c: x - c)] * 2)
    # six centers a row: the number of clusters is a parameter
    near = members.join(pin(centers), F.lit(True)).select("review_id", "cluster_id", "other", gap.alias("gap"))
    best = near.groupBy("review_id", "cluster_id").agg(
        F.min("gap").alias("least"), F.min(F.when(F.col("other") == F.col("cluster_id"), F.col("gap"))).alias("own")
    )
    # k-means stops within a tolerance, so a center may be off by that much
    return best.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("cluster_id").alias("clusters"),
        F.count_if(F.col("own") > F.col("least") * 1.05 + 1e-9).alias("misplaced"),
    )


def select_k(spark: SparkSession, folder: str) -> DataFrame:
    choice = clustering.select_k(materialize(pca_projection(spark, folder)))
    return spark.createDataFrame(
        [(k, s, k == choice.k) for k, s in choice.scores.items()],
        "k int, silhouette double, chosen boolean",
    )


def k_check(spark: SparkSession, folder: str) -> DataFrame:
    """Values of k tried, the largest silhouette minus the chosen one's, and scores out of range."""
    scores = select_k(spark, folder)
    chosen = F.max(F.when(F.col("chosen"), F.col("silhouette")))
    return scores.agg(
        F.count(F.lit(1)).alias("tried"), F.count_if("chosen").alias("chosen"),
        (F.max("silhouette") - chosen).alias("behind"),
        F.count_if(~F.col("silhouette").between(-1, 1)).alias("out_of_range"),
    )


def clustering_job(spark: SparkSession, folder: str) -> DataFrame:
    vectors = Tables(spark, folder).vectors.select("review_id", "embedding")
    return clustering.cluster_reviews(vectors).clusters


def clustering_check(spark: SparkSession, folder: str) -> DataFrame:
    """What any run of the job has to satisfy: sizes add up to the rows, k is in range, small
    clusters are merged, and every representative is a member, named once."""
    vectors = Tables(spark, folder).vectors.select("review_id", "embedding")
    job = clustering.cluster_reviews(vectors)
    picks = job.clusters.select("cluster_id", F.explode("representatives").alias("review_id"))
    strangers = picks.join(job.members, ["cluster_id", "review_id"], "left_anti").count()
    named = picks.agg(F.count(F.lit(1)) - F.count_distinct("cluster_id", "review_id")).first()[0]
    k = job.stats.first()["k"]
    kept = F.col("cluster_id") != C.OTHER_CLUSTER_ID
    return job.clusters.agg(
        F.sum("size").alias("rows"), F.lit(C.K_MIN <= k <= C.K_MAX).alias("k_in_range"),
        F.count_if(kept & (F.col("size") < C.MIN_CLUSTER_SIZE)).alias("too_small"),
        F.lit(strangers).cast("bigint").alias("strangers"), F.lit(named).cast("bigint").alias("named_twice"),
    )


def whole_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on all reviews with the offline models; returns the topics that came out."""
    from reviewmill.plans.analysis import analyze
    from reviewmill.sources import stages

    root = f"{shared_dir(spark)}/reviewmill-analysis"
    store = analyze(Tables(spark, folder).reviews, root, force=True)
    topics = stages.load_results(store)[stages.TOPICS]
    return topics.select("cluster_id", "size", "topic", "sentiment",
                         F.size("representative_quotes").alias("quotes"))


def replay(spark: SparkSession, folder: str) -> DataFrame:
    """The whole analysis again on the same input: every stage but the report is reused."""
    from reviewmill.plans.analysis import analyze
    from reviewmill.sources import stages

    root = f"{shared_dir(spark)}/reviewmill-analysis"
    store = analyze(Tables(spark, folder).reviews, root)
    topics = stages.load_results(store)[stages.TOPICS]
    return topics.select("cluster_id", "size", "topic", "sentiment",
                         F.size("representative_quotes").alias("quotes"))


def letter_histogram():
    """A stand-in for an outside model: counts of the 26 letters; tokens = characters.

    An inner function travels to the tasks by value, so workers need not find this module.
    """

    def embed(texts: list[str]) -> tuple[np.ndarray, int]:
        out = np.zeros((len(texts), 26), dtype=np.float32)
        for row, text in zip(out, texts):
            counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
            row[:] = counts[65:91] + counts[97:123]
        return out, sum(map(len, texts))

    return embed


def embed_text(spark: SparkSession, folder: str) -> DataFrame:
    embedded = embedding.embed_reviews(
        Tables(spark, folder).texts.select("review_id", "text"), letter_histogram()
    )
    return embedded.select("review_id", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


def offline_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Width and length of the built-in model's vectors: length 1, or 0 for a text without a word."""
    texts = Tables(spark, folder).texts.select("review_id", "text")
    embedded = embedding.embed_offline(embedding.fit_offline_embedder(texts), texts)
    length = F.sqrt(V.dot(F.col("embedding"), F.col("embedding")))
    return embedded.select("review_id", F.size("embedding").alias("width"), F.round(length, 4).alias("length"))


def embed_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and price of embedding every review."""
    embedded = embedding.embed_reviews(
        Tables(spark, folder).texts.select("review_id", "text"), letter_histogram()
    )
    calls = embedding.embedding_usage(embedded, "embedding", "text-embedding-3-small")
    return ledger.call_cost(calls).agg(
        F.sum("tokens_in").alias("tokens_in"), F.round(F.sum("cost"), 6).alias("cost")
    )


# --- text enrichment ---------------------------------------------------------------------


def topic_prompt(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    picks = pin(selection.representatives(tables.vectors))
    # the picks cut the texts down before the answers are joined
    picked = tables.texts.join(picks.select("review_id").distinct(), "review_id", "left_semi")
    return enrichment.topic_prompts(picks, picked.join(tables.answers, "review_id", "left"))


def _plain_topics(tables: Tables) -> DataFrame:
    return pin(tables.answered.select("cluster_id").distinct()).withColumn(
        "topic", F.concat(F.lit("topic "), F.col("cluster_id").cast("string"))
    )


def issue_prompt(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    picks = pin(selection.negative_sample(_negative_vectors(tables)))
    return enrichment.issue_prompts(picks, tables.texts, _plain_topics(tables))


def _topic_replies(tables: Tables) -> DataFrame:
    """One reply per labelled review, in the shapes that a model may return."""
    doc = F.col("doc_id").cast("string")
    shape = F.pmod("doc_id", F.lit(6))
    full = F.concat(
        F.lit('{"topic":"t'), doc, F.lit('","topic_en":"e'), doc,
        F.lit('","summary":["a","b"],"summary_en":["c"],"sentiment":"positive","keywords_ko":[],'
              '"keywords_en":["k1","k2"],"representative_quote_ids":['), doc, F.lit(',"x",'),
        (F.col("doc_id") + 1).cast("string"), F.lit("]}"),
    )
    reply = (
        F.when(shape == 0, full)
        .when(shape == 1, F.concat(F.lit('{"topic":"t'), doc, F.lit('"}')))
        .when(shape == 2, F.lit('{"topic":null,"sentiment":"negative","summary":null}'))
        .when(shape == 3, F.lit("{}"))
        .when(shape == 4, F.lit('{"topic_en":"only","representative_quote_ids":[999999999]}'))
    )
    return tables.read("labels").select(
        F.col("doc_id").alias("cluster_id"),
        reply.alias("response"),
        F.when(shape == 5, "timeout").alias("error"),
    )


def response_parse(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    doc = F.col("doc_id")
    clusters = tables.read("labels").select(
        doc.alias("cluster_id"),
        F.col("quality").cast("bigint").alias("size"),
        F.array(doc, doc + 2, doc + 4, doc + 6).alias("representatives"),
    )
    records = enrichment.parse_topics(
        _topic_replies(tables), clusters, tables.texts.select("review_id", "text")
    )
    return records.select(
        "cluster_id", "size", "topic", "topic_en", "sentiment",
        *[F.array_join(c, "|").alias(c)
          for c in ("summary", "summary_en", "keywords_ko", "keywords_en")],
        F.array_join(F.col("representative_quotes.review_id").cast("array<string>"), ",")
        .alias("quote_ids"),
        F.array_join(F.transform("representative_quotes", lambda q: X.clip(q.text, 200)), "|")
        .alias("quotes"),
    )


def issue_parse(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    shape = F.pmod("doc_id", F.lit(5))
    reply = (
        F.when(shape == 0, F.concat(
            F.lit('{"issues":[{"title":"a'), doc, F.lit('","title_en":"b","description":"d",'
                  '"description_en":"e","severity":"critical","frequency":'), doc,
            F.lit(',"representative_quote_ids":['), doc,
            F.lit(']},{"title":"second","frequency":null}]}')))
        .when(shape == 1, F.lit('{"issues":[{"frequency":"7.9","severity":"blocker"}]}'))
        .when(shape == 2, F.lit('{"issues":[]}'))
        .when(shape == 3, F.lit("{}"))
    )
    calls = Tables(spark, folder).read("labels").select(
        F.col("doc_id").alias("cluster_id"),
        reply.alias("response"),
        F.when(shape == 4, "timeout").alias("error"),
    )
    return enrichment.parse_issues(calls).withColumn(
        "quote_ids", F.array_join("quote_ids", ",")
    ).withColumn("priority", L.priority(F.col("severity")))


def quote_resolution(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    doc = F.col("doc_id")
    wanted = tables.read("labels").select(
        "doc_id",
        F.array(
            doc.cast("string"), F.lit("x1"), (doc + 1).cast("string"),
            (doc + 100_000_000).cast("string"), doc.cast("string"),
        ).alias("quote_ids"),
    )
    resolved = enrichment.resolve_quotes(wanted, ["doc_id"], tables.texts)
    first = F.slice("quotes", 1, C.REPORT_QUOTES)
    return resolved.select(
        "doc_id",
        F.array_join(F.transform(first, lambda q: q.review_id.cast("string")), ",").alias("ids"),
        F.array_join(F.transform(first, lambda q: q.text), "\n").alias("texts"),
    )


def cluster_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return extractive.cluster_sentiment(Tables(spark, folder).active_answered).withColumn(
        "recommended_share", F.round("recommended_share", 6)
    )


def cluster_keywords(spark: SparkSession, folder: str) -> DataFrame:
    counts = Tables(spark, folder).term_counts
    return extractive.cluster_keywords(counts).withColumn("weight", F.round("weight", 4))


def _issues(tables: Tables) -> DataFrame:
    return extractive.extractive_issues(tables.members, tables.term_counts)


def negative_issues(spark: SparkSession, folder: str) -> DataFrame:
    return _issues(Tables(spark, folder)).withColumn("quote_ids", F.array_join("quote_ids", ","))


def negative_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return extractive.negative_counts(Tables(spark, folder).active_answered).withColumn(
        "negative_ratio", F.round("negative_ratio", 6)
    )


# --- views, report, tickets ----------------------------------------------------------------


def explorer_filter(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    rows = views.attach_cluster(tables.reviews, tables.vectors)
    return views.explorer_filter(
        rows, clusters=[1, 2, 3, 4, 5], langs=["en", "fr"], recommended=True,
        playtime=(5.0, 150.0), search="Then",
    ).select("review_id", "lang", "recommended", "playtime_hours", "cluster_id")


def explorer_page(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    rows = views.page(tables.texts.select("review_id", "lang", "playtime_hours", "text"), 3)
    return views.attach_cluster(rows, tables.vectors, C.OTHER_CLUSTER_ID).select(
        "review_id", "lang", "playtime_hours", "cluster_id", "text"
    )


def stored_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of all reviews, from a table stored in the order of pages."""
    path = f"{shared_dir(spark)}/reviewmill-pages-{uuid.uuid4().hex}"
    paged.write_pages(Tables(spark, folder).texts.select("review_id", "lang", "playtime_hours", "text"), path)
    return paged.read_page(spark, path, 3)


def text_search(spark: SparkSession, folder: str) -> DataFrame:
    """All reviews that hold a string in any letter case, through the index of their files."""
    table, index = f"{folder}/documents.parquet", f"{shared_dir(spark)}/reviewmill-index-{uuid.uuid4().hex}"
    text_index.write_text_index(spark, table, index)
    return text_index.search_text(spark, table, index, "Then ").select(F.col("doc_id").alias("review_id"), "lang")


def key_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of words that stand together more often than by chance, in all texts."""
    found = phrases.phrases(Tables(spark, folder).texts, extractive.default_stop_words())
    return found.withColumn("ratio", F.round("ratio", 3))


def explorer_facets(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return views.explorer_facets(
        views.attach_cluster(tables.texts, tables.vectors, C.OTHER_CLUSTER_ID)
    )


def page_count(spark: SparkSession, folder: str) -> DataFrame:
    return views.page_count(Tables(spark, folder).read("documents"))


def _topics(tables: Tables) -> DataFrame:
    members = tables.members
    sizes = pin(clustering.cluster_sizes(members))
    picks = selection.nearest_per_cluster(members, 5)
    return extractive.extractive_topics(members, tables.term_counts, picks, sizes)


def _names(tables: Tables) -> DataFrame:
    topics = _plain_topics(tables)
    return topics.withColumn("topic_en", F.upper("topic"))


def _negatives(tables: Tables) -> DataFrame:
    counts = extractive.negative_counts(tables.active_answered)
    return enrichment.negative_records(counts, _names(tables), _issues(tables), tables.members)


def topic_ranking(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return views.topic_ranking(
        _topics(tables), extractive.negative_counts(tables.active_answered), "negative_ratio", ["positive", "mixed"]
    ).withColumn("negative_ratio", F.round("negative_ratio", 6))


def issue_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return views.issue_ranking(_negatives(Tables(spark, folder))).select(
        "cluster_id", "topic", "issue_no", "title", "severity", "severity_rank", "severity_label",
        "frequency",
        F.size("representative_quotes").alias("quotes"),
    )


def total_issues(spark: SparkSession, folder: str) -> DataFrame:
    return views.total_issues(_negatives(Tables(spark, folder)))


def issue_table(spark: SparkSession, folder: str) -> DataFrame:
    return export.issue_table(_negatives(Tables(spark, folder)))


def ticket_rows(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return export.ticket_rows(_names(tables), _negatives(tables)).withColumn(
        "labels", F.array_join("labels", ",")
    )


def topic_sections(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return export.topic_sections(_topics(tables), _negatives(tables))


def _kpis(tables: Tables) -> DataFrame:
    flags, threshold = _flags(tables)
    active = tables.active_answered
    placed = tables.vectors.join(active.select("review_id"), "review_id", "left_semi")
    return views.kpi_summary(
        cleaning.clean_stats(evaluation.inject_mojibake(tables.texts)),
        spam.spam_stats(flags, threshold),
        clustering.cluster_sizes(active).agg(
            F.count_if(F.col("cluster_id") != C.OTHER_CLUSTER_ID).alias("k"),
            F.lit(clustering.silhouette(placed)).alias("sample_silhouette"),
        ),
        extractive.negative_counts(active),
        ledger.total_cost(ledger.call_cost(_calls(tables))),
    )


def kpi_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _kpis(Tables(spark, folder)).withColumn("value", F.round("value", 6))


def report_sections(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    block = export.kpi_block(_kpis(tables), "2024-01-01 00:00 UTC")
    return export.report_sections(_topics(tables), _negatives(tables), block)


# --- cost ledger -----------------------------------------------------------------------------


def _calls(tables: Tables) -> DataFrame:
    """Events stand for model calls; every sixth user calls a model without a price."""
    names = F.array(*[F.lit(m) for m in C.MODEL_PRICES], F.lit("unlisted"))
    return tables.read("events").select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("step"),
        F.element_at(names, (F.pmod("user_id", F.lit(6)) + 1).cast("int")).alias("model"),
        F.pmod("event_id", F.lit(1000)).alias("tokens_in"),
        F.pmod("user_id", F.lit(100)).alias("tokens_out"),
    )


def call_cost(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.call_cost(_calls(Tables(spark, folder))).withColumn(
        "cost", F.round("cost", 9)
    )


def cost_by_step(spark: SparkSession, folder: str) -> DataFrame:
    costs = ledger.call_cost(_calls(Tables(spark, folder)))
    return ledger.cost_by_step(costs).withColumn("cost", F.round("cost", 6))


def total_cost(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.total_cost(ledger.call_cost(_calls(Tables(spark, folder))))


ALL = [
    active_cluster_summary,
    clean_text_score, mojibake_repair, blank_filter, repair_examples, clean_stats,
    lang_distribution, url_marker, clip_text, inject_spam,
    cosine_to_prototypes, spam_threshold, spam_flags, spam_stats, spam_candidates, spam_override,
    active_reviews, spam_recall,
    cluster_centroids, nearest_centroid, nearest_per_cluster, mmr_per_cluster, representatives,
    negative_sample, tiny_cluster_merge, cluster_sizes, silhouette_exact, silhouette_euclidean, uniform_sample_ids,
    paraphrase_agreement,
    variant_agreement, pca_projection, pca_distance, kmeans_assign, kmeans_check, select_k, k_check, clustering_job,
    clustering_check, whole_analysis, replay, embed_text, offline_embedding, embed_usage,
    topic_prompt, issue_prompt, response_parse, issue_parse, quote_resolution, cluster_sentiment,
    cluster_keywords, negative_issues, negative_ratio,
    explorer_filter, explorer_page, stored_page, text_search, key_phrases, explorer_facets, page_count, topic_ranking, issue_ranking, total_issues,
    issue_table, ticket_rows, topic_sections, kpi_summary, report_sections,
    call_cost, cost_by_step, total_cost,
]
QUERIES = {q.__name__: q for q in ALL}
