"""The whole analysis: clean, embed and flag spam, cluster, topics, complaints, report.

Rows stay whole from the second stage on: text, answers, vector and scores travel in one table, so
neither dropping spam nor assigning clusters needs a join. Each stage is stored and later read
column by column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple, dataclass
from datetime import datetime, timezone
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Observation, Row, functions as F

from reviewmill import constants as C
from reviewmill.operators import (
    cleaning, clustering, embedding, enrichment, export, extractive, ledger, selection, spam, views,
)
from reviewmill.operators.scale import pin
from reviewmill.schema import require_unique_ids, select_required
from reviewmill.sources import sinks, stages

EmbedFn = Callable[[list[str]], tuple[np.ndarray, int]]
ClientFn = Callable[[str], tuple[str, int, int]]


@dataclass(frozen=True)
class Parameters:
    target_spam_ratio: float = C.TARGET_SPAM_RATIO
    min_positive_similarity: float = C.MIN_POSITIVE_SIMILARITY
    min_similarity_gap: float = C.MIN_SIMILARITY_GAP
    k_min: int = C.K_MIN
    k_max: int = C.K_MAX
    pca_dim: int = C.PCA_DIM
    min_cluster_size: int = C.MIN_CLUSTER_SIZE
    restarts: int = C.KMEANS_RESTARTS
    min_negatives: int = C.MIN_NEGATIVES
    negative_sample_size: int = C.NEGATIVE_SAMPLE_SIZE
    negative_nearest: int = C.NEGATIVE_NEAREST
    offline_width: int = 256
    seed: int = C.SEED


@dataclass
class Outside:
    """The models outside the engine. Without them, built-in offline methods are used."""

    embed_fn: EmbedFn | None = None
    embed_model: str = "text-embedding-3-small"
    client_fn: ClientFn | None = None
    client_model: str = "gpt-4o-mini"


def _prototype_table(embed: Callable[[list[str]], np.ndarray]):
    texts = [*C.POSITIVE_PROTOTYPES, *C.NEGATIVE_PROTOTYPES]
    return texts, np.asarray(embed(texts), dtype=np.float64), len(C.POSITIVE_PROTOTYPES)


def analyze(
    reviews: DataFrame,
    root: str,
    outside: Outside = Outside(),
    parameters: Parameters = Parameters(),
    force: bool = False,
    run_id: str | None = None,
    input_id: str | None = None,
) -> stages.StageStore:
    """Run every stage that is not stored yet, then write report and tickets.

    input_id identifies the input, for example a file_fingerprint; without one the rows are hashed,
    which reads the input once more.

    Returns the store; load_results gives its tables, and <root>/ledger holds the costs of all
    runs.
    """
    spark = reviews.sparkSession
    p = parameters
    now = datetime.now(timezone.utc)
    run_id = run_id or now.strftime("%Y%m%dT%H%M%S%f")
    reviews = select_required(reviews)
    models = (outside.embed_fn is not None, outside.embed_model,
              outside.client_fn is not None, outside.client_model)
    if input_id is None:
        folder = stages.table_fingerprint(reviews, astuple(p), models)
    else:
        folder = stages.combined_fingerprint(input_id, astuple(p), models)
    store = stages.StageStore(spark, root, folder)
    ledger_path = f"{root.rstrip('/')}/ledger"

    def pay(calls: DataFrame) -> None:
        sinks.append_calls(ledger.call_cost(calls), ledger_path, run_id)

    def one_call(step: str, model: str, tokens: int) -> DataFrame:
        return spark.createDataFrame(
            [(step, model, tokens, 0, "all")],
            "step string, model string, tokens_in bigint, tokens_out bigint, call string",
        )

    # 1. clean
    if force or not store.done(stages.CLEAN_STATS):
        counted = Observation("clean")
        clean = store.write(
            stages.CLEAN, cleaning.clean_observed(reviews, counted), require_unique_ids
        )
        row = spark.createDataFrame([Row(**counted.get)])
        store.write(stages.LANGUAGES, cleaning.language_distribution(clean))
        store.write(stages.REPAIR_EXAMPLES, cleaning.repair_examples(reviews))
        clean_stats = store.write(stages.CLEAN_STATS, row)
    else:
        store.reused += [stages.CLEAN, stages.LANGUAGES, stages.REPAIR_EXAMPLES, stages.CLEAN_STATS]
        clean, clean_stats = store.read(stages.CLEAN), store.read(stages.CLEAN_STATS)

    # 2. embed and score; the threshold is one number over all rows
    def scored() -> DataFrame:
        if outside.embed_fn is None:
            model = embedding.fit_offline_embedder(clean, p.offline_width)
            embedded = embedding.embed_offline(model, clean).withColumn(
                "call_tokens", F.lit(0).cast("bigint")
            ).withColumn("opens_call", F.lit(False))

            def embed(texts):
                frame = spark.createDataFrame(list(enumerate(texts)), "review_id bigint, text string")
                rows = embedding.embed_offline(model, frame).orderBy("review_id").collect()
                return [r["embedding"] for r in rows]

            prototypes = _prototype_table(embed)
        else:
            spent = []

            def embed(texts):
                matrix, tokens = outside.embed_fn(texts)
                spent.append(int(tokens))
                return matrix

            embedded = embedding.embed_reviews(clean, outside.embed_fn)
            prototypes = _prototype_table(embed)
            pay(one_call("embedding_prototypes", outside.embed_model, sum(spent)))
        return spam.score_rows(embedded, prototypes)

    def pay_embedding(table: DataFrame) -> None:
        if outside.embed_fn is not None:
            pay(embedding.embedding_usage(table, "embedding", outside.embed_model))

    # calls are paid for before their stage counts as done: a crash in between loses no cost
    rows = store.stage(stages.SCORED, scored, force, pay_embedding)
    stats_known = not force and store.done(stages.SPAM_STATS)
    if stats_known:
        threshold = store.read(stages.SPAM_STATS).first()["threshold_pos"]
    else:
        threshold = spam.positive_threshold(
            rows, p.target_spam_ratio, p.min_positive_similarity
        )
    flags = store.stage(
        stages.FLAGS, lambda: spam.flag(rows, threshold, p.min_similarity_gap), force
    )
    spam_stats = store.stage(
        stages.SPAM_STATS,
        lambda: spam.spam_stats(flags, threshold, p.min_similarity_gap),
        force,
    )
    active = rows.where(~spam.is_spam(threshold, p.min_similarity_gap)).select(
        "review_id", "text", "lang", "recommended", "embedding"
    )

    # 3. cluster
    if force or not store.done(stages.CLUSTER_STATS):
        found = clustering.cluster_reviews(
            active, p.k_min, p.k_max, p.pca_dim, p.min_cluster_size, p.restarts, seed=p.seed,
            keep=lambda df: store.write(stages.MEMBERS, df),
        )
        store.write(stages.CLUSTERS, found.clusters)
        store.write(stages.CLUSTER_STATS, found.stats)
    else:
        store.reused += [stages.MEMBERS, stages.CLUSTERS, stages.CLUSTER_STATS]
    members = store.read(stages.MEMBERS)
    clusters = pin(store.read(stages.CLUSTERS))
    cluster_stats = store.read(stages.CLUSTER_STATS)
    picks = clusters.select(
        "cluster_id", F.posexplode("representatives").alias("_pos", "review_id")
    ).select("cluster_id", "review_id", (F.col("_pos") + 1).alias("rank"))
    texts = members.select("review_id", "text", "lang", "recommended")

    @cache
    def term_counts() -> DataFrame:
        return store.stage(
            stages.TERM_COUNTS,
            lambda: extractive.review_term_counts(members, extractive.default_stop_words()),
            force,
        )

    # 4. topics
    def ask(prompts: DataFrame, stage: str, step: str) -> DataFrame:
        return store.stage(
            stage,
            lambda: enrichment.call_model(pin(prompts), outside.client_fn),
            force,
            lambda calls: pay(enrichment.usage(calls, step, outside.client_model, "cluster_id")),
        )

    def topics_table() -> DataFrame:
        if outside.client_fn is None:
            return extractive.extractive_topics(members, term_counts(), picks, clusters)
        prompts = enrichment.topic_prompts(picks, texts)
        calls = ask(prompts, stages.TOPIC_CALLS, "cluster_naming")
        return enrichment.parse_topics(calls, clusters, texts)

    topics = store.stage(stages.TOPICS, topics_table, force)

    # 5. complaints
    counts = pin(extractive.negative_counts(members))

    def negatives_table() -> DataFrame:
        if outside.client_fn is None:
            issues = extractive.extractive_issues(members, term_counts(), p.min_negatives)
        else:
            enough = counts.where(F.col("negative_review_count") >= p.min_negatives)
            complaining = members.where(~F.col("recommended")).join(
                enough.select("cluster_id"), "cluster_id", "left_semi"
            )
            sample = selection.negative_sample(
                complaining, p.negative_sample_size, p.negative_nearest
            )
            prompts = enrichment.issue_prompts(sample, texts, topics)
            issues = enrichment.parse_issues(
                ask(prompts, stages.ISSUE_CALLS, "negative_reasons")
            )
        return enrichment.negative_records(counts, topics, issues, texts)

    negatives = store.stage(stages.NEGATIVES, negatives_table, force)

    # 6. report, always written anew; costs are those of all runs on this ledger's run id
    spent = sinks.read_calls(spark, ledger_path).where(F.col("run_id") == run_id)
    kpis = store.write(
        stages.KPIS,
        views.kpi_summary(
            clean_stats, spam_stats, cluster_stats, counts, ledger.total_cost(spent)
        ),
    )
    store.write(stages.COST_BY_STEP, ledger.cost_by_step(spent))
    block = export.kpi_block(kpis, now.strftime("%Y-%m-%d %H:%M UTC"))
    sinks.write_report(
        export.report_sections(topics, negatives, block), store.path("06_report.md")
    )
    tickets = export.ticket_rows(topics, negatives)
    sinks.write_tickets(tickets, store.path("06_tickets"))
    sinks.write_ticket_payload(tickets, store.path("06_tickets.json"))
    return store
