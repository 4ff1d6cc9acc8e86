"""Files in, report out: sources, stages, sinks, streaming and the whole analysis."""

import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.operators import embedding, evaluation, extractive, spam
from reviewmill.plans.analysis import Outside, Parameters, analyze
from reviewmill.schema import DuplicateReviews, MissingColumns, require_unique_ids
from reviewmill.sources import reviews as R, sinks, stages
from reviewmill.streaming import ingest

CSV = (
    "extra,review_id,text,lang,recommended,playtime_hours,posted_at\n"
    'x,1,"two\nlines, ""quoted""",english,True,1.5,2024-01-01\n'
    "x,2,,koreana,False,,\n"
    "x,oops,hi,en,,abc,\n"
)


def test_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(CSV, encoding="utf-8")
    rows = R.read_reviews_csv(spark, str(good)).collect()
    assert tuple(rows[0]) == (1, 'two\nlines, "quoted"', "english", True, 1.5, "2024-01-01")
    assert tuple(rows[1]) == (2, None, "koreana", False, None, None)
    assert rows[2]["review_id"] is None and rows[2]["playtime_hours"] is None
    assert R.check_reviews_csv(spark, str(good)) == (True, "OK")
    bad = tmp_path / "bad.csv"
    bad.write_text("review_id,text\n1,a\n")
    ok, message = R.check_reviews_csv(spark, str(bad))
    assert not ok and message.endswith("lang, playtime_hours, posted_at, recommended")
    with pytest.raises(MissingColumns):
        R.read_reviews_csv(spark, str(bad))
    assert R.check_reviews_csv(spark, str(tmp_path / "none.csv"))[0] is False


def test_ids_must_be_unique(spark):
    ids = spark.createDataFrame([(1,), (2,), (1,)], "review_id bigint")
    with pytest.raises(DuplicateReviews):
        require_unique_ids(ids)


def test_fingerprints(spark, tmp_path):
    import hashlib

    f = tmp_path / "a.csv"
    f.write_bytes(b"some bytes")
    assert stages.file_fingerprint(spark, str(f)) == hashlib.sha1(b"some bytes").hexdigest()[:12]
    df = spark.range(100).withColumn("t", F.lit("x"))
    one = stages.table_fingerprint(df, 1)
    assert one == stages.table_fingerprint(df.orderBy(F.desc("id")).repartition(7), 1)
    assert one != stages.table_fingerprint(df, 2)
    assert one != stages.table_fingerprint(df.unionByName(df.limit(1)), 1)
    assert one != stages.table_fingerprint(df.unionByName(df.limit(1)).unionByName(df.limit(1)), 1)


def test_fingerprint_of_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "LEAF_BYTES", 1000)
    chance = np.random.default_rng(4)
    data = bytearray(chance.integers(0, 256, 300_000, dtype=np.uint8).tobytes().replace(b"\n\n", b"\r\n"))
    file = tmp_path / "large.csv"

    def of(content, split="64m"):
        file.write_bytes(bytes(content))
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            return stages.file_fingerprint(spark, str(file))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    whole = of(data)
    assert {of(data, split) for split in ("8k", "50k", "111111")} == {whole}
    changed = set()
    for at in (0, 4095, 4096, 150_000, len(data) - 1):
        other = bytearray(data)
        other[at] ^= 1
        changed.add(of(other, "30k"))
    lines = bytes(data).split(b"\n")
    changed.add(of(b"\n".join([lines[1], lines[0], *lines[2:]])))
    changed |= {of(data + b"\n"), of(data[:-1]), of(data + b"\0")}
    assert len(changed | {whole}) == 10
    folder = tmp_path / "both"
    folder.mkdir()
    (folder / "a").write_bytes(bytes(data))
    (folder / "b").write_bytes(b"small")
    both = stages.file_fingerprint(spark, str(folder))
    (folder / "b").write_bytes(b"smalL")
    assert len({both, stages.file_fingerprint(spark, str(folder)), whole}) == 3


def test_a_repeated_stage_pays_once(spark, tmp_path):
    """The stage dies between paying and its marker; the same run repeats it, with one call more."""
    path = str(tmp_path / "ledger")
    store = stages.StageStore(spark, str(tmp_path), "abc")
    rows = spark.range(6).select(
        F.lit("naming").alias("step"), F.lit("m").alias("model"), F.lit(5).cast("bigint").alias("tokens_in"),
        F.lit(0).cast("bigint").alias("tokens_out"), F.lit(0.5).alias("cost"), F.col("id").cast("string").alias("call"))

    def pay_and_die(table):
        sinks.append_calls(table, path, "run")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        store.stage("calls", lambda: rows.limit(5), check=pay_and_die)
    assert not store.done("calls") and sinks.read_calls(spark, path).count() == 5
    store.stage("calls", lambda: rows, check=lambda table: sinks.append_calls(table, path, "run"))
    paid = sinks.read_calls(spark, path)
    assert store.done("calls") and paid.count() == paid.select("seq").distinct().count() == 6
    sinks.append_calls(rows, path, "another run")
    assert sinks.read_calls(spark, path).count() == 12


def test_stage_is_computed_once(spark, tmp_path):
    store = stages.StageStore(spark, str(tmp_path), "abc")
    runs = []

    def compute():
        runs.append(1)
        return spark.range(len(runs))

    assert store.stage("s", compute).count() == 1
    assert store.stage("s", compute).count() == 1 and store.reused == ["s"]
    assert store.stage("s", compute, force=True).count() == 2
    assert stages.load_results(store) is None
    half = stages.StageStore(spark, str(tmp_path), "half")
    spark.range(3).write.parquet(half.path("s"))  # a table without its marker is not done
    assert half.stage("s", compute).count() == 3 and half.reused == []


def test_a_failed_forced_run_leaves_no_stage_done(spark, tmp_path):
    store = stages.StageStore(spark, str(tmp_path), "abc")
    for name in (stages.CLEAN, stages.SCORED, stages.TOPICS):
        store.write(name, spark.range(2))
    failing = spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.stage(stages.SCORED, lambda: failing, force=True)
    assert [store.done(n) for n in (stages.CLEAN, stages.SCORED, stages.TOPICS)] == [True, False, False]
    assert store.stage(stages.SCORED, lambda: spark.range(4)).count() == 4


def test_ledger_keys_are_unique_in_a_run(spark, tmp_path):
    path = str(tmp_path / "ledger")
    calls = spark.range(0, 20, 1, 4).select(
        F.lit("s").alias("step"), F.lit("m").alias("model"), F.col("id").alias("tokens_in"),
        F.lit(0).cast("bigint").alias("tokens_out"), F.lit(0.5).alias("cost"))
    for run in ("a", "b", "a"):
        sinks.append_calls(calls, path, run)
    rows = sinks.read_calls(spark, path)
    assert rows.count() == rows.select("run_id", "seq").distinct().count() == 60


def test_values_that_do_not_parse_are_counted(spark, tmp_path):
    file = tmp_path / "some.csv"
    file.write_text(CSV, encoding="utf-8")
    assert R.unparsable(spark, str(file)).first().asDict() == {
        "review_id": 1, "text": 0, "lang": 0, "recommended": 0, "playtime_hours": 1, "posted_at": 0}
    with pytest.raises(DuplicateReviews, match="no review_id"):
        require_unique_ids(R.read_reviews_csv(spark, str(file)))


def hashed_words(texts):
    out = np.zeros((len(texts), 32), dtype=np.float32)
    for row, text in zip(out, texts):
        for word in text.lower().split():
            row[zlib.crc32(word.encode()) % 32] += 1
    return out, sum(len(t.split()) for t in texts)


def test_embedding_calls_are_batched(spark):
    texts = spark.createDataFrame(
        [(i, "w " * (i % 3)) for i in range(600)], "review_id bigint, text string").coalesce(1)
    done = embedding.embed_reviews(texts, hashed_words).persist()
    calls = embedding.embedding_usage(done, "embedding", "m").collect()
    assert len(calls) == 3 and sum(c["tokens_in"] for c in calls) == 600
    assert done.where("review_id = 2").first()["embedding"][zlib.crc32(b"w") % 32] == 2.0
    assert done.count() == 600 and done.columns[:2] == ["review_id", "text"]


def test_new_texts_find_their_cluster(spark):
    def at(text):
        return [float(v) for v in hashed_words([text])[0][0]]

    centroids = spark.createDataFrame(
        [(4, at("bug crash")), (2, at("story plot"))], "cluster_id int, centroid array<double>")
    probes = spark.createDataFrame(
        [(1, "plot"), (2, "crash crash bug"), (3, "story story")], "review_id bigint, text string")
    placed = evaluation.place_reviews(probes, hashed_words, centroids)
    assert placed.columns == ["review_id", "text", "cluster_id", "similarity"]
    assert {r["review_id"]: r["cluster_id"] for r in placed.collect()} == {1: 2, 2: 4, 3: 2}


def test_offline_embedding_has_unit_length(spark):
    texts = spark.createDataFrame(
        [(1, "good game"), (2, "bad bugs"), (3, " ")], "review_id bigint, text string")
    model = embedding.fit_offline_embedder(texts, 64)
    rows = {r["review_id"]: r for r in embedding.embed_offline(model, texts).collect()}
    assert np.linalg.norm(rows[1]["embedding"]) == pytest.approx(1, abs=1e-6)
    assert rows[3]["text"] == " " and len(rows[3]["embedding"]) == 64


def test_keywords_skip_stop_words_and_break_ties_by_term(spark):
    rows = [(0, "the the story story plot"), (0, "the story zebra"), (1, "the bug bug crash"), (1, "alpha")]
    df = spark.createDataFrame(rows, "cluster_id int, text string")
    words = extractive.default_stop_words(["english"])
    assert "the" in words
    counts = extractive.review_term_counts(df.withColumn("recommended", F.lit(True)), words)
    got = extractive.cluster_keywords(counts, 3).orderBy("cluster_id", "rank").collect()
    assert [r["term"] for r in got] == ["story", "plot", "zebra", "bug", "alpha", "crash"]
    mean = (5 + 4) / 2
    assert got[0]["weight"] == pytest.approx(3 * np.log(1 + mean / 3))


def test_injected_spam_recall(spark):
    flags = spark.createDataFrame(
        [(1, True), (900001, True), (900002, False)], "review_id bigint, is_spam boolean")
    injected = spark.createDataFrame([(900001,), (900002,)], "review_id bigint")
    assert tuple(evaluation.recall(flags, injected).first()) == (2, 1, 0.5)


def test_stream_flags_new_files_once(spark, tmp_path):
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    prototypes = (["spam", "fair"], np.array([[1.0, 0.0], [0.0, 1.0]]), 1)
    schema = ("review_id bigint, text string, lang string, recommended boolean, "
              "playtime_hours double, posted_at string, embedding array<float>")

    def deliver(rows):
        spark.createDataFrame(
            [(i, t, "en", True, 1.0, "", v) for i, t, v in rows], schema
        ).write.mode("append").parquet(incoming)

    def run():
        scored = ingest.stream_scored(spark, incoming, prototypes)
        query = ingest.append_flags(scored, 0.32, out, str(tmp_path / "ckpt"))
        query.awaitTermination()
        return {r["review_id"]: r["is_spam"] for r in spark.read.parquet(out).collect()}

    deliver([(1, "hello", [0.0, 1.0]), (2, "buy", [1.0, 0.1]), (3, "  ", [1.0, 0.0])])
    assert run() == {1: False, 2: True}
    deliver([(4, "see www.x.com", [0.0, 1.0])])
    assert run() == {1: False, 2: True, 4: True}


PRAISE = ["story plot quest hero", "graphics visuals art light", "music sound score theme",
          "combat sword boss fight", "coop friends party online", "price sale value deal"]


@pytest.fixture(scope="module")
def game_reviews(spark):
    rows = []
    for i in range(360):
        kind = i % 6
        text = f"{PRAISE[kind]} {PRAISE[kind]} {PRAISE[kind].split()[i % 4]}"
        bad = i % 5 == 0
        if bad:
            text += " crash lag" if kind == 3 else " boring lag"
        if i % 60 == 7:
            text = "visit www.shop.com"
        rows.append((i, text, "english", None if i % 7 == 0 else not bad, float(i), ""))
    rows.append((1000, "   ", "english", True, 0.0, ""))
    rows.append((1001, "그래픽이 좋다 story".encode().decode("latin-1"), "koreana", True, 0.0, ""))
    return spark.createDataFrame(
        rows, "review_id bigint, text string, lang string, recommended boolean, "
              "playtime_hours double, posted_at string").repartition(4)


FAST = Parameters(restarts=2, min_cluster_size=10, pca_dim=10)


def test_analysis_with_outside_models(spark, game_reviews, tmp_path):
    def client(prompt):
        first = prompt.split("[id=")[1].split(",")[0]
        if "부정 리뷰" in prompt:
            return json.dumps({"issues": [
                {"title": "지연", "title_en": "lag", "severity": "major", "frequency": 4,
                 "representative_quote_ids": [first]}]}), 100, 10
        return json.dumps({"topic": "주제", "topic_en": "topic", "summary": ["s"],
                           "sentiment": "positive", "representative_quote_ids": [first]}), 50, 5

    outside = Outside(embed_fn=hashed_words, client_fn=client)
    store = analyze(game_reviews, str(tmp_path), outside, FAST, run_id="r1")
    tables = stages.load_results(store)
    assert all(t is not None for t in tables.values())
    clean = tables[stages.CLEAN_STATS].first()
    assert (clean["input_count"], clean["output_count"], clean["encoding_repaired"]) == (362, 361, 1)
    spam_stats = tables[stages.SPAM_STATS].first()
    assert spam_stats["url_boost_count"] == 6 and spam_stats["spam_count"] >= 6
    sizes = tables[stages.CLUSTER_STATS].first()["cluster_sizes"]
    assert sum(sizes.values()) == 361 - spam_stats["spam_count"]
    topics = tables[stages.TOPICS].collect()
    assert {t["cluster_id"] for t in topics} == set(sizes)
    assert all(len(t["representative_quotes"]) == 1 for t in topics)
    negatives = tables[stages.NEGATIVES].collect()
    for n in negatives:
        assert len(n["issues"]) == (1 if n["negative_review_count"] >= 5 else 0)
    report = "".join(p.read_text() for p in Path(store.path("06_report.md")).glob("part-*"))
    assert report.startswith("# Steam 리뷰 분석 리포트\n\n## 📊 KPI 요약\n\n| 지표 | 값 |\n")
    assert report.count("### 클러스터 ") == len(sizes)
    payload = json.loads("".join(
        p.read_text() for p in Path(store.path("06_tickets.json")).glob("part-*")))
    assert len(payload["issueUpdates"]) == sum(len(n["issues"]) for n in negatives)
    lines = [l for p in Path(store.path("06_tickets")).glob("part-*")
             for l in p.read_text().splitlines()]
    assert len(lines) == len(payload["issueUpdates"])

    ledger = sinks.read_calls(spark, f"{tmp_path}/ledger")
    steps = {r["step"]: r["n"] for r in ledger.groupBy("step").agg(F.count("*").alias("n")).collect()}
    assert steps["embedding_prototypes"] == 1 and steps["cluster_naming"] == len(sizes)
    assert steps["negative_reasons"] == len(payload["issueUpdates"])
    tokens = ledger.where("step = 'embedding'").agg(F.sum("tokens_in")).first()[0]
    assert tokens == sum(len(r["text"].split()) for r in tables[stages.CLEAN].collect())

    again = analyze(game_reviews.repartition(2), str(tmp_path), outside, FAST, run_id="r2")
    assert again.folder == store.folder and stages.TOPICS in again.reused
    assert sinks.read_calls(spark, f"{tmp_path}/ledger").where("run_id = 'r2'").count() == 0
    assert sinks.read_calls(spark, f"{tmp_path}/ledger").count() == ledger.count() > 0


def test_analysis_offline(spark, game_reviews, tmp_path):
    store = analyze(game_reviews, str(tmp_path), parameters=FAST)
    tables = stages.load_results(store)
    sizes = tables[stages.CLUSTER_STATS].first()["cluster_sizes"]
    topics = {t["cluster_id"]: t for t in tables[stages.TOPICS].collect()}
    assert set(topics) == set(sizes)
    assert all(t["topic"] and t["keywords_en"] for t in topics.values())
    issues = [(n["cluster_id"], i) for n in tables[stages.NEGATIVES].collect() for i in n["issues"]]
    assert issues and {i["severity"] for _, i in issues} <= {"critical", "major", "minor"}
    assert any(i["severity"] == "critical" and "crash" in i["title"] for _, i in issues)
    members = {r["review_id"]: r["text"] for r in tables[stages.MEMBERS].collect()}
    for _, issue in issues:
        assert 1 <= len(issue["representative_quotes"]) <= 3
        assert all(issue["title"] in members[q["review_id"]] for q in issue["representative_quotes"])
    kpis = {r["metric"]: r["value"] for r in tables[stages.KPIS].collect()}
    assert kpis["normal_count"] == kpis["output_count"] - kpis["spam_count"] == sum(sizes.values())
    assert sinks.read_calls(spark, f"{tmp_path}/ledger").count() == 0
