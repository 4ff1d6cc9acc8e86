"""The registered queries: each applies one operator to its whole table and shapes the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import (
    bpe, chat, language, mixing, neighbours, pagetext, passages, runs, search, simhash, toxicity, warc, whitening,
)
from reviewmill.llm.oracle import CLOSING_TEXT
from reviewmill.llm.scratch import prepare

VOCABULARY_FILE = "word_bpe_49k.json"
QUERY_STEP = 100
NEIGHBOURS = 10
SEARCH_STEP, SEARCH_RESULTS = 20, 10
FOLDS, HELD_OUT_FOLD = 4, 2
TOXIC_FOLDS, TOXIC_HELD_OUT = 5, 0
WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and the components of those at most 4 bits apart."""
    docs = _table(spark, folder, "documents")
    return simhash.near_copies(docs).select(
        F.col("key").alias("doc_id"),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def key_hash(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary"))


def held_out(key: str = "doc_id", folds: int = FOLDS, fold: int = HELD_OUT_FOLD):
    return F.coalesce(F.pmod(key_hash(key), F.lit(folds)) == fold, F.lit(False))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the labelled ones outside the held-out fold."""
    docs = _table(spark, folder, "documents")
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out())
    model = language.train(known, order=F.xxhash64("doc_id"))
    return language.identify(docs, model).select(
        F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "lang_pred", "score"
    )


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix with source weights 5, 2, 1 takes of every document."""
    mixture = mixing.mix(_table(spark, folder, "documents"))
    return mixture.taken().select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The passages of every document that repeat one of an earlier document, with the documents they repeat."""
    return passages.spans(passages.repeated_passages(_table(spark, folder, "documents")))


def op5_pagetext(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return pagetext.extract(_table(spark, folder, "pages")).select(
        F.col("key").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers  # only here: the other queries need no vocabulary files

    return bpe.Vocabulary(public_tokenizers.path(VOCABULARY_FILE))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    words = vocabulary()
    coded = bpe.decode(bpe.encode(_table(spark, folder, "documents"), words), words)
    return coded.select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector."""
    asked = F.col("vec_id") % QUERY_STEP == 0
    return neighbours.nearest(_table(spark, folder, "embeddings"), asked, NEIGHBOURS)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages through archives and back."""
    return warc.archived(_table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    closing = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CLOSING_TEXT).alias("text"),
    )
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    messages = chat.as_trees(rows.unionByName(closing))
    formatted = chat.format_paths(chat.best_paths(messages), messages)
    back = formatted.select(
        F.col("tree").alias("conv_id"), "formatted",
        chat.read_back(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    said = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 best documents for the whole text of every twentieth document."""
    docs = _table(spark, folder, "documents")
    found = search.top_k(docs, F.col("doc_id") % SEARCH_STEP == 0, SEARCH_RESULTS)
    return found.withColumn("score", F.round("score", 6))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """How likely every document is to be marked toxic, learned from the labelled rows outside the held-out fold."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    fold = held_out(folds=TOXIC_FOLDS, fold=TOXIC_HELD_OUT)
    model = toxicity.train(docs, labels.where(F.col("doc_id").isNotNull() & ~fold))
    return toxicity.scored(docs, model).select(
        F.col("key").alias("doc_id"), held_out("key", TOXIC_FOLDS, TOXIC_HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The whitened leading components of every vector."""
    rows, model = whitening.whiten(_table(spark, folder, "embeddings"))
    parts = [float(e) / model.trace for e in model.eigenvalues]
    explained = F.element_at(F.array(*[F.lit(p) for p in parts]).cast("array<double>"), F.col("at") + 1)
    return rows.select("key", "deviation", F.posexplode("whitened").alias("at", "white")).select(
        F.col("key").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"), "deviation", F.col("white").alias("whitened"),
        explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def periodic_tails(docs: DataFrame) -> DataFrame:
    """The documents, in every tenth of which (by hash) the words from one place on repeat a short sequence."""
    marked = docs.select("doc_id", "text", key_hash("doc_id").alias("h"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    planted = (F.col("h") % 10 == 0) & F.col("text").rlike(WORD)
    cut = marked.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(planted, words).alias("words"))
    n = F.size("words")
    start = F.col("g") % n
    at = cut.select(
        "doc_id", "text", "words", start.cast("int").alias("a"),
        (1 + F.floor((n - start) / (3 + F.col("g") % 8))).cast("int").alias("p"), n.alias("n"),
    )
    repeated = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))),
    )
    return at.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document and its text without their repetitions."""
    found = runs.periodic_runs(periodic_tails(_table(spark, folder, "documents")))

    def stronger(best, run):
        more = run["length"] * best["period"] > best["length"] * run["period"]  # in order of start, then period: ties stay
        return F.when(best.isNull() | more, run).otherwise(best)

    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        F.aggregate("runs", nothing, stronger).alias("best"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_mixing": op3_mixing,
    "op4_passages": op4_passages,
    "op5_pagetext": op5_pagetext,
    "op6_bpe": op6_bpe,
    "op7_neighbours": op7_neighbours,
    "op8_warc": op8_warc,
    "op9_chat": op9_chat,
    "op10_search": op10_search,
    "op11_toxicity": op11_toxicity,
    "op12_whitening": op12_whitening,
    "op13_runs": op13_runs,
}
