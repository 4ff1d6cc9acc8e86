"""From raw documents to tokens: language, near copies, repeated passages, source weights, byte-pair encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import bpe, language, mixing, passages, simhash
from reviewmill.llm.queries import held_out, vocabulary
from reviewmill.llm.scratch import prepare, stored


ROW_NAME = "_name_of_row"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language. Learns from the labelled rows outside the held-out fold; documents without a
    letter, null ones among them, are rejected. If no row is labelled, every document is undetermined and none is left."""
    prepare(spark)
    model = language.train(docs.where(F.col("doc_id").isNotNull() & ~held_out()), order=F.xxhash64("doc_id"))
    told = language.identified_rows(docs, model).where(F.col("lang_pred") != language.UNDETERMINED)
    return told.select(*[F.col(f"carried.`{c}`").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the first row of the smallest doc_id, rows of one doc_id in the order of
    a hash of the whole row. Rows of a doc_id with unlike texts are documents of their own, each judged with its own group.
    Rows without doc_id stay only where no row of their group has one, one of them for each group.

    Documents are near copies as operator 1 has it: fingerprints at most 4 bits apart, and chains of them.
    """
    prepare(spark)
    # a row's own name, in the order in which rows of a group are preferred
    name = F.struct(
        F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        F.xxhash64(*docs.columns).alias("hash"),
    )
    named = docs.withColumn(ROW_NAME, name)
    groups = simhash.near_copies(named, key=ROW_NAME)
    first = groups.where(F.col("key") == F.col("component")).select(F.col("key").alias("_first")).distinct()
    kept = named.join(first, F.col(ROW_NAME) == F.col("_first"), "left_semi")
    return kept.dropDuplicates([ROW_NAME]).drop(ROW_NAME)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat one of a smaller doc_id; a document with no word left goes. Documents
    that had no words before, null ones too, stay as they are."""
    prepare(spark)
    spans = passages.spans(passages.repeated_passages(docs)).select("doc_id", "begin", "end")
    marked = docs.withColumn("_words", F.col("text").rlike(mixing.WORD))
    cut = passages.cut_texts(marked, spans)
    left = cut.where(~F.coalesce("_words", F.lit(False)) | F.col("text").rlike(mixing.WORD)).drop("_words")
    return _counted(left)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them, repeats included; one row a document. A document of
    which nothing is taken goes: one without words, and one that the draws of its source leave out."""
    prepare(spark)
    return _counted(mixing.mixed_texts(docs, mixing.mix(docs)))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text of every document."""
    prepare(spark)
    coded = bpe.round_trip(docs, vocabulary())
    return coded.select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256"
    )


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: Minima over hashes, draws and merges are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each result but the last is a written table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
