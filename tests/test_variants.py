"""Paraphrases made from the reviews themselves, by their vectors."""

import numpy as np

from reviewmill.functions.vectors import unit_rows
from reviewmill.operators import embedding, evaluation
from reviewmill.plans import queries
from reviewmill.plans.standin import Tables


def test_variants_say_the_same(spark):
    reviews = spark.createDataFrame([(1, "große Welt, 좋은 게임"), (2, "plain words here"), (3, None)], "review_id bigint, text string")
    said = {(r["probe_group"], r["variant"]): r["text"] for r in evaluation.variants(reviews, ["and more", "once again"]).collect()}
    assert len(said) == 12
    assert said[1, "plain"] == said[1, "repaired"] == "große Welt, 좋은 게임"
    assert said[1, "longer"] == "große Welt, 좋은 게임 once again" and said[2, "longer"] == "plain words here and more"
    assert said[2, "reversed"] == "here words plain" and said[3, "reversed"] == ""


def test_query_against_brute_force(spark, folder):
    rows = {r["probe_group"]: r for r in queries.variant_agreement(spark, folder).collect()}
    tables = Tables(spark, folder)
    texts = tables.texts.select("review_id", "text")
    assert len(rows) == texts.count() and {r["probes"] for r in rows.values()} == {4}
    model = embedding.fit_offline_embedder(texts)
    own = {r["review_id"]: r["embedding"] for r in embedding.embed_offline(model, texts).collect()}
    given = {r["review_id"]: r["cluster_id"] for r in tables.vectors.select("review_id", "cluster_id").collect()}
    members = {c: np.array([own[i] for i in own if given.get(i) == c]) for c in sorted(set(given.values()))}
    names = [c for c in members if len(members[c])]
    centroids = unit_rows([members[c].astype(float).mean(axis=0) for c in names])
    probes = embedding.embed_offline(model, evaluation.variants(texts, queries.SPAM_PHRASES)).toPandas()
    similar = unit_rows(np.stack(probes["embedding"])) @ centroids.T
    best = np.sort(similar, axis=1)
    sure = best[:, -1] - best[:, -2] > 1e-6  # hashed vectors of copies may tie
    probes["cluster"], probes["sure"] = similar.argmax(axis=1), sure
    for group, part in probes.groupby("probe_group"):
        if part["sure"].all():
            assert rows[group]["clusters"] == part["cluster"].nunique()
            assert rows[group]["agrees"] == (part["cluster"].nunique() == 1)
    # the same words in another order have the same vector
    turned = probes[probes["variant"].isin(["plain", "reversed", "repaired"]) & probes["sure"]].groupby("probe_group")["cluster"].nunique()
    assert (turned == 1).mean() > 0.95
